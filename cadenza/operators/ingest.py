"""Listen events: parsing with reasons, hashing, sessions, duplicates and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import exprs as X
from cadenza.operators.identity import listen_identity

_INFO = (
    "struct<recording_mbid:string,recording_msid:string,spotify_id:string,spotify_track_id:string,"
    "submission_client_track_id:string,media_player_track_id:string>"
)
_LISTEN = (
    "user_name:string,user_id:string,listened_at:string,timestamp:string,track_metadata:struct<track_name:string,artist_name:string,"
    "release_name:string,recording_msid:string,mbid_mapping:struct<recording_mbid:string,release_mbid:string,artist_mbids:array<string>>,"
    f"additional_info:{_INFO}>"
)
#: Where from_json puts a line that is no JSON, or that does not fit.
CORRUPT = "__corrupt"
LINE = f"struct<{_LISTEN},{CORRUPT}:string,payload:struct<user_name:string,listens:array<struct<{_LISTEN}>>>>"


def flatten(lines: DataFrame) -> DataFrame:
    """(origin, line, entry, listen, malformed) of JSON lines (origin, line, value): one row for each listen.

    Blank lines give nothing. An envelope {user_name, payload: {listens: […]}} gives a row for each element, which inherits
    the user. What is not an object is a malformed row.
    """
    text = X.strip(F.col("value"))
    parsed = F.when(text.startswith("{"), F.from_json("value", LINE, {"columnNameOfCorruptRecord": CORRUPT}))
    read = lines.filter(text != "").select("origin", "line", "value", parsed.alias("r"))
    # A line is parsed once; only one that does not fit is parsed again, to tell whether it is JSON at all.
    ok = F.col("r").isNotNull() & (F.col(f"r.{CORRUPT}").isNull() | F.try_parse_json("value").isNotNull())
    read = read.select("origin", "line", F.when(ok, F.col("r")).alias("r"))
    single = F.struct(*[F.col(f"r.{c}") for c in ("user_name", "user_id", "listened_at", "timestamp", "track_metadata")])
    user = F.coalesce(X.non_empty(F.col("r.user_name")), X.non_empty(F.col("r.payload.user_name")))
    inner = F.transform("r.payload.listens", lambda x: F.when(x.isNotNull(), x.withField("user_name", F.coalesce(X.non_empty(x["user_name"]), user))))
    entries = F.when(F.col("r").isNull(), F.array(F.lit(None).cast(f"struct<{_LISTEN}>"))).when(F.col("r.payload.listens").isNotNull(), inner).otherwise(F.array(single))
    out = read.select("origin", "line", F.posexplode(entries).alias("entry", "listen"))
    return out.withColumn("malformed", F.col("listen").isNull())


def parse(flat: DataFrame) -> DataFrame:
    """The listens with user, epoch, identifiers and names, and the reason of a rejected one (null where accepted)."""
    m, info = "listen.track_metadata", "listen.track_metadata.additional_info"
    user = F.coalesce(X.non_empty(F.col("listen.user_name")), X.non_empty(F.col("listen.user_id")))
    epoch = F.coalesce(X.non_empty(F.col("listen.listened_at")), X.non_empty(F.col("listen.timestamp"))).try_cast("bigint")
    mbid = F.coalesce(X.safe_uuid(F.col(f"{m}.mbid_mapping.recording_mbid")), X.safe_uuid(F.col(f"{info}.recording_mbid")))
    msid = F.coalesce(X.safe_uuid(F.col(f"{m}.recording_msid")), X.safe_uuid(F.col(f"{info}.recording_msid")))
    provider = F.coalesce(*[X.non_empty(F.col(f"{info}.{k}")) for k in ("spotify_id", "spotify_track_id", "submission_client_track_id", "media_player_track_id")])
    out = flat.select(
        "origin", "line", "entry", "malformed", user.alias("user"), epoch.alias("epoch"), mbid.alias("mbid"), msid.alias("msid"), X.track_id(provider).alias("provider_id"),
        X.non_empty(F.col(f"{m}.track_name")).alias("track"), X.non_empty(F.col(f"{m}.artist_name")).alias("artist"), X.non_empty(F.col(f"{m}.release_name")).alias("release"),
        X.valid_uuids(F.col(f"{m}.mbid_mapping.artist_mbids")).alias("artist_mbids"), F.col(m).isNull().alias("no_metadata"),
    )
    reason = (
        F.when(F.col("malformed"), "malformed")
        .when(F.col("user").isNull(), "user")
        .when(F.col("epoch").isNull(), "time")
        .when(F.col("no_metadata"), "metadata")
        .when(F.coalesce("mbid", "msid", "track").isNull(), "identity")
    )
    return out.withColumn("reason", reason).drop("no_metadata", "malformed")


def hashed(parsed: DataFrame, salt: str, seconds: int = 1800) -> DataFrame:
    """Accepted listens with user hash, session key, event signature and canonical identity."""
    ok = parsed.filter("reason is null").withColumn("user_hash", X.user_hash(F.col("user"), salt))
    fields = [F.col(c) for c in ("user_hash", "epoch", "mbid", "msid", "provider_id", "track", "artist", "release")]
    return ok.withColumns(
        {
            "session_key": X.session_key(F.col("user_hash"), F.col("epoch"), seconds),
            "signature": X.event_signature(*fields),
            "identity": listen_identity(F.col("mbid"), F.col("msid"), F.col("provider_id")),
        }
    )


def first_events(events: DataFrame) -> DataFrame:
    """One row for each signature, the one with the smallest reference."""
    others = [c for c in events.columns if c != "signature"]
    least = F.min(F.struct("ref", *[c for c in others if c != "ref"])).alias("e")
    return events.groupBy("signature").agg(least).select("signature", "e.*")


def session_items(events: DataFrame) -> DataFrame:
    """(session_key, item, first_at, last_at, plays) of events (session_key, item, at)."""
    return events.filter("item is not null").groupBy("session_key", "item").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("plays")
    )


def merge_session_items(a: DataFrame, b: DataFrame) -> DataFrame:
    """Partial aggregates of session_items put together."""
    return a.unionByName(b).groupBy("session_key", "item").agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("plays").alias("plays")
    )


def resume(rows: DataFrame, origin: str, line: int, entry: int) -> DataFrame:
    """The rows after a checkpoint; an origin that the rows lack is an error."""
    if not rows.filter(F.col("origin") == origin).limit(1).count():
        raise ValueError(f"no rows come from {origin}")
    later = (F.col("line") > line) | ((F.col("line") == line) & (F.col("entry") > entry))
    return rows.filter((F.col("origin") > origin) | ((F.col("origin") == origin) & later))


def counters(parsed: DataFrame) -> DataFrame:
    """One row of counts over parsed listens, in one pass."""
    ok = F.col("reason").isNull()
    return parsed.agg(
        F.count("*").alias("rows"),
        F.count_if(ok).alias("accepted"),
        *[F.count_if(F.col("reason") == r).alias(f"no_{r}") for r in ("malformed", "user", "time", "metadata", "identity")],
        F.count_if(ok & F.col("mbid").isNotNull()).alias("by_mbid"),
        F.count_if(ok & F.col("mbid").isNull() & F.col("msid").isNotNull()).alias("by_msid"),
        F.count_if(ok & F.coalesce("mbid", "msid", "provider_id").isNull()).alias("unresolved"),
    )
