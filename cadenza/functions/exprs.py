"""Column builders: hashing, identifiers, normalisation, JSON, time and policy expressions."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that str.strip() removes and trim() does not, in the ASCII range.
BLANKS = " \t\n\r\u000b\f\u001c\u001d\u001e\u001f"
# Fixed value: the namespace of item identifiers.
UUID_NAMESPACE = "9f291c3dbb5c4fd7a1cd730f4f9dc9b7"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def non_empty(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


# Case folding by rule: letters that fold to one letter, and those that fold to several.
_FOLDED = {c: c.casefold() for c in map(chr, range(sys.maxunicode + 1)) if c.casefold() != c and not 0xD800 <= ord(c) <= 0xDFFF}
_ONE = {c: f for c, f in _FOLDED.items() if len(f) == 1}
_MANY = {c: f for c, f in _FOLDED.items() if len(f) > 1}


def casefold(c: Column) -> Column:
    """Full Unicode case folding; ASCII text needs lower() alone, and only text with a letter like \u00df is split."""
    one = F.translate(c, "".join(_ONE), "".join(_ONE.values()))
    table = F.create_map(*[F.lit(x) for pair in _MANY.items() for x in pair])
    many = F.array_join(F.transform(F.split(one, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).when(one.rlike(f"[{''.join(_MANY)}]"), many).otherwise(one)


def key_suffix(key: Column, prefix: str) -> Column:
    """What follows a prefix in a canonical key; null where the key lacks it."""
    return F.when(key.startswith(prefix), F.substring(key, len(prefix) + 1, 2**31 - 1))


def split_bucket(key: Column, buckets: int) -> Column:
    """The first 16 hex digits of the key's sha256 as an unsigned number, modulo buckets."""
    number = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (number % F.lit(buckets).cast("decimal(20,0)")).cast("int")


def partition_label(key: Column, buckets: int) -> Column:
    return F.concat(F.lit("p"), F.lpad(split_bucket(key, buckets).cast("string"), 3, "0"))


def partition_index(session: Column, item: Column, signature: Column, buckets: int) -> Column:
    """The partition of an event: the first 8 bytes of sha256 over the session key and the item's id, or where there is
    none the event's signature, as an unsigned number modulo buckets. Keys and signatures are binary."""
    own = F.when(F.coalesce(item, F.lit("")) != "", F.encode(item, "UTF-8")).otherwise(signature)
    number = F.conv(F.substring(F.sha2(F.concat(session, own), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (number % F.lit(buckets).cast("decimal(20,0)")).cast("int")


def user_hash(user: Column, salt: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(salt), user), 256)


def session_key(user: Column, epoch: Column, seconds: int = 1800) -> Column:
    """Hex sha256 of the user's hash and the number of the fixed window that the time falls in."""
    return F.sha2(F.concat(user, F.lit(":"), F.floor(epoch / seconds).cast("bigint").cast("string")), 256)


def event_signature(*fields: Column) -> Column:
    """Hex sha256 of the fields, stripped, case-folded and joined by a unit separator; null counts as empty."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(casefold(strip(f.cast("string"))), F.lit("")) for f in fields]), 256)


def dashed(hex32: Column) -> Column:
    return F.regexp_replace(hex32, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def md5_uuid(c: Column) -> Column:
    return dashed(F.md5(c))


def uuid5(name: Column, namespace_hex: str = UUID_NAMESPACE) -> Column:
    """RFC 4122 name-based identifier, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    return dashed(F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), F.lower(F.hex(variant)), F.substring(h, 18, 15)))


def safe_uuid(c: Column) -> Column:
    """The canonical lower-case form of any accepted spelling (braces, urn prefix, no dashes), else null."""
    h = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^urn:", ""), "^uuid:", ""), "[{}-]", ""))
    return F.when(h.rlike("^[0-9a-f]{32}$"), dashed(h))


def valid_uuids(a: Column) -> Column:
    return F.filter(F.transform(a, safe_uuid), lambda x: x.isNotNull())


def isrc_strip(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"[-\s]", ""))


def isrc_alnum(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[^0-9A-Za-z]", ""))


def isrc_valid(c: Column) -> Column:
    return c.rlike("^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$")


# What a url's text says about its provider, first match wins.
PROVIDERS = (
    ("open.spotify.com/", "spotify"),
    ("spotify.com/track/", "spotify"),
    ("music.apple.com/", "apple_music"),
    ("itunes.apple.com/", "apple_music"),
    ("youtube.com/", "youtube"),
    ("youtu.be/", "youtube"),
    ("soundcloud.com/", "soundcloud"),
    ("bandcamp.com/", "bandcamp"),
    ("deezer.com/", "deezer"),
    ("tidal.com/", "tidal"),
)


def ordered_match(c: Column, rules=PROVIDERS, other: str = "other") -> Column:
    """The name of the first rule whose text the lower-cased column contains."""
    out = None
    for text, name in rules:
        hit = F.lower(c).contains(text)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(other) if out is None else out.otherwise(other)


def alias_key(source: Column, kind: Column, key: Column) -> Column:
    """Normalised (source, kind, key), or null where any is blank."""
    s, k, i = F.lower(strip(source)), F.lower(strip(kind)), strip(key)
    blank = (F.coalesce(s, F.lit("")) == "") | (F.coalesce(k, F.lit("")) == "") | (F.coalesce(i, F.lit("")) == "")
    return F.when(~blank, F.struct(s.alias("source"), k.alias("kind"), i.alias("key")))


def first_identity(*choices: tuple[str, Column]) -> Column:
    """Struct (type, key) of the first choice that is not null."""
    return F.coalesce(*[F.when(c.isNotNull(), F.struct(F.lit(t).alias("type"), c.alias("key"))) for t, c in choices])


def track_id(c: Column) -> Column:
    """The 22-character id in a uri (a:track:id), a url (…/track/id?…) or the id itself, else null."""
    found = F.regexp_extract(strip(c), r"^(?:[a-z]+:track:|https?://[^/]+/(?:[a-z-]+/)?track/)?([0-9A-Za-z]{22})(?:[?#/].*)?$", 1)
    return F.nullif(found, F.lit(""))


def normalized_list(a: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(a, strip), lambda x: x != "")))


def padded(vector: Column, size: int) -> Column:
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0).cast("float"), size)), 1, size)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine clipped to 0..1 and rounded half-even to two places; null for a zero norm or nan."""
    value = F.try_divide(dot(a, b), norm_a * norm_b)
    return F.when(~F.isnan(value), F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 2))


def token_vector(tokens: Column, size: int = 32) -> Column:
    """The tokens' sha1 bytes summed into the first 20 of `size` places, as a unit vector; no tokens count as 'unknown'."""
    tokens = F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lit("unknown")))
    # What several expressions share is the one element of an array, so that it is computed once a row and not once a place.
    shared = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)

    def sums(hashes: Column) -> Column:
        byte = lambda h, i: F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("double")
        total = lambda i: F.aggregate(hashes, F.lit(0.0), lambda s, h: s + byte(h, i)) if i < 20 else F.lit(0.0)
        return F.array(*[total(i) for i in range(size)])

    def unit(totals: Column) -> Column:
        norm = F.sqrt(F.aggregate(totals, F.lit(0.0), lambda s, x: s + x * x))
        return shared(norm, lambda n: F.transform(totals, lambda x: F.try_divide(x, n)))

    return shared(F.transform(tokens, lambda t: F.sha1(t)), lambda hashes: shared(sums(hashes), unit))


def partial_date(c: Column) -> Column:
    """A date from YYYY, YYYY-MM or YYYY-MM-DD, the missing parts being 1; else null."""
    s = strip(c)
    full = F.when(s.rlike(r"^\d{4}$"), F.concat(s, F.lit("-01-01"))).when(s.rlike(r"^\d{4}-\d{2}$"), F.concat(s, F.lit("-01")))
    return full.otherwise(s).try_cast("date")


def slug(c: Column, most: int = 24) -> Column:
    """Lower-case words joined by dashes, cut to `most`; the sha1's start where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s != "", F.substring(s, 1, most)).otherwise(F.substring(F.sha1(c), 1, most))


def backoff_seconds(attempts: Column, most: int = 3600) -> Column:
    return F.least(F.lit(float(most)), F.pow(F.lit(2.0), attempts.cast("double"))).cast("bigint")


def detail_limit(zoom: Column) -> Column:
    """Least weight shown at a zoom level."""
    return F.when(zoom <= 4, 0.5).when(zoom <= 8, 0.2).when(zoom <= 12, 0.05).otherwise(0.0)


def escaped_label(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def metric_line(name: str, value: Column, **labels: Column) -> Column:
    """name{label="value",…} value"""
    pairs = [F.concat(F.lit(f'{k}="'), escaped_label(v.cast("string")), F.lit('"')) for k, v in labels.items()]
    return F.concat(F.lit(name + "{"), F.concat_ws(",", *pairs), F.lit("} "), value.cast("string"))


def attribute_tokens(attributes: Column) -> Column:
    """All values of a map of lists as one list of lower-case tokens, in key order."""
    ordered = F.array_sort(F.map_entries(attributes))
    return F.flatten(F.transform(ordered, lambda e: F.transform(e["value"], lambda x: F.lower(x))))


def attribute_values(json: Column) -> Column:
    """The values of a JSON object, strings and lists of strings, as one list in the object's order, their case kept; other
    values, and what is no object, give none."""
    entries = F.map_values(F.from_json(json, "map<string,string>"))
    text = F.map_values(F.from_json(json, "map<string,variant>"))
    value = lambda v, raw: (
        F.when(F.schema_of_variant(v).startswith("ARRAY"), F.filter(F.from_json(raw, "array<string>"), lambda x: x.isNotNull()))
        .when(F.schema_of_variant(v) == "STRING", F.array(raw))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.coalesce(F.flatten(F.zip_with(text, entries, value)), F.array().cast("array<string>"))


def place(degrees: Column) -> Column:
    """A latitude or longitude at two places, half-even."""
    return F.bround(degrees, 2)


def unit(value: Column) -> Column:
    """A number clamped to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def utc_text(time: Column) -> Column:
    """A time as YYYY-MM-DDTHH:MM:SSZ."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def merged_json(json: Column, more: Column) -> Column:
    """A flat JSON object with the entries of a map added; the map's win."""
    read = F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(read, lambda k, v: ~F.map_contains_key(more, k))
    return F.to_json(F.map_concat(kept, more))


def first_or(values: Column, other: str) -> Column:
    return F.coalesce(F.try_element_at(values, F.lit(1)), F.lit(other))
