"""Groups of spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

One edit changes a word's letter counts by a vector of squared length 1 (a letter more or less) or 2 (another letter), so
words whose counts lie further apart are no candidates. Words are dealt into blocks by their length and by how many of
their letters fall into each of GROUPS classes of letters. An edit moves a word to its own block or to one that differs by
one letter more in a class, or by one more in a class and one less in another; only such blocks meet, and a product of
their count matrices gives the squared distances of all their words at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm import kernels
from cadenza.session import materialize

# Letters of a run, and the order in which they are counted.
RUN = r"[A-Za-zÀ-ÿ]+"
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Classes of letters (code point modulo GROUPS) that divide words of one length into blocks.
GROUPS = 6
#: A block of more words, or of more code points, is cut into chunks by hash; every chunk meets every chunk.
CHUNK_WORDS, CHUNK_POINTS = 256, 1 << 14
#: Pairs of blocks that a task multiplies before it verifies their candidates, and code points verified at once.
ROWS, VERIFY_POINTS = 32, 1 << 19
#: One run in so many loses a letter.
EVERY = 199
#: A form is at least so many times as frequent as its word.
TIMES = 5

_STEP = [1 << (10 * g) for g in range(GROUPS)]
#: From a block's key to those of the blocks that it meets: itself, one letter more in a class, or one moved between two.
_MOVES = [0, *_STEP, *(_STEP[i] - _STEP[j] for i in range(GROUPS) for j in range(i))]
_COLUMN = np.full(0x100, -1, np.int64)
_COLUMN[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))


def _lower(run: Column) -> Column:
    """A-Z lower-cased, and nothing else; for plain ASCII Spark's lower is the same and faster."""
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, least_n: int = 5, every: int = EVERY) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased, of at least `least` code points and `least_n` occurrences.

    Where `every` divides the unsigned crc32 of "<id>:<run>", the run loses its code point crc32 modulo its length before it is counted.
    A row without an id loses none. Null texts have no runs; a repeated row counts again. Runs are counted in each task before they
    are shuffled, so a frequent word is one row of a task; a text of any length is read whole, by one task.
    """
    runs = docs.select(F.col(id_col).cast("string").alias("__id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.char_length("run") >= least).select("__id", _lower(F.col("run")).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("__id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter((F.char_length("word") >= least) & (F.col("n") >= least_n))


def _points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the words and where each word begins (n + 1 values)."""
    found = words.to_pylist()
    points = np.frombuffer("".join(found).encode("utf-32-le"), np.uint32)
    return points, np.cumsum([0, *map(len, found)])


def _counts(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of letter counts for each word."""
    n = len(at) - 1
    flat = np.repeat(np.arange(n), np.diff(at)) * len(LETTERS) + _COLUMN[points]
    return np.bincount(flat, minlength=n * len(LETTERS)).reshape(n, len(LETTERS)).astype(np.float32)


def _blocks(words: DataFrame) -> DataFrame:
    """(key, chunk, words: array of (word, n)). A key adds GROUPS counts at ten bits each, modulo 2**64: keys of
    other blocks that fall together only cause idle comparisons."""

    def run(batches: Iterator[pa.RecordBatch]):
        step = np.array(_STEP, np.uint64)
        for batch in batches:
            points, at = _points(kernels.column(batch, "word"))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(step[points % GROUPS], dtype=np.uint64)])
            keys = (total[at[1:]] - total[at[:-1]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(kernels.column(batch, c) for c in ("word", "n")), pa.array(keys)], names=["word", "n", "key"])

    keyed = materialize(words.mapInArrow(run, "word string, n long, key long"), "keyed")
    sizes = keyed.groupBy("key").agg(F.greatest(F.count("*") / CHUNK_WORDS, F.sum(F.char_length("word")) / CHUNK_POINTS).alias("size"))
    keyed = keyed.join(sizes.select("key", F.ceil("size").alias("chunks")), "key")
    keyed = keyed.withColumn("chunk", F.pmod(F.xxhash64("word"), "chunks"))
    return keyed.groupBy("key", "chunk").agg(F.collect_list(F.struct("word", "n")).alias("words"))


def _one_edit(a: tuple[np.ndarray, np.ndarray], i: np.ndarray, b: tuple[np.ndarray, np.ndarray], j: np.ndarray) -> np.ndarray:
    """Which pairs (a[i], b[j]) differ by exactly one edit; b's word is as long as a's or longer by one code point.

    Both are compared up to their first difference; what follows must be the same after one code point of b, and one of a
    where they are of one length."""
    la, lb = np.diff(a[1])[i], np.diff(b[1])[j]
    good = (lb == la) | (lb == la + 1)
    i, j, la, lb = i[good], j[good], la[good], lb[good]
    first = np.concatenate([[0], np.cumsum(la)])
    row = np.repeat(np.arange(len(la)), la)
    k = np.arange(first[-1]) - first[row]
    at_a, at_b = a[1][i][row] + k, b[1][j][row] + k
    own, same = a[0][at_a], a[0][at_a] == b[0][at_b]
    unlike = np.where(same, np.iinfo(np.int64).max, k)
    prefix = np.minimum(np.minimum.reduceat(unlike, first[:-1]), la) if len(la) else la
    longer = lb > la
    after = np.where(longer[row], k >= prefix[row], k > prefix[row])
    shifted = b[0][np.minimum(at_b + longer[row], len(b[0]) - 1)]
    wrong = np.bincount(row[after & (own != shifted)], minlength=len(la)) > 0
    out = np.zeros(len(good), bool)
    out[np.flatnonzero(good)] = ~wrong & (longer | (prefix < la))
    return out


NEAR = "word string, n long, near string, near_n long"


def _near(pairs: DataFrame) -> DataFrame:
    """Every near pair of each row's two blocks (a, b), in both directions; of one block with itself (own) each pair once."""

    def side(batch, name):
        listed = kernels.column(batch, name)
        words, n = listed.flatten().field("word"), listed.flatten().field("n").to_numpy()
        points, at = _points(words)
        counts = _counts(points, at)
        first = np.concatenate([[0], np.cumsum(listed.value_lengths().to_numpy(zero_copy_only=False))])
        return words, n, (points, at), counts, (counts * counts).sum(1), first

    def run(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                (wa, na, ta, ca, qa, fa), (wb, nb, tb, cb, qb, fb) = side(batch, "a"), side(batch, "b")
                own = kernels.column(batch, "own").to_numpy(zero_copy_only=False)
                i, j = [], []
                for r in range(batch.num_rows):
                    x, y = slice(fa[r], fa[r + 1]), slice(fb[r], fb[r + 1])
                    # |a - b|^2 <= 2 where a.b >= (|a|^2 + |b|^2) / 2 - 1; counts are small whole numbers, so this is exact.
                    close = ca[x] @ cb[y].T >= (qa[x] / 2 - 1)[:, None] + (qb[y] / 2)[None, :]
                    if own[r]:
                        close = np.triu(close, 1)
                    p, q = np.nonzero(close)
                    i.append(p + fa[r])
                    j.append(q + fb[r])
                i, j = np.concatenate(i), np.concatenate(j)
                step = max(1, VERIFY_POINTS // max(1, int(np.diff(ta[1]).max(initial=0))))
                near = [_one_edit(ta, i[k : k + step], tb, j[k : k + step]) for k in range(0, len(i), step)]
                near = np.concatenate([np.zeros(0, bool), *near])
                i, j = pa.array(i[near]), pa.array(j[near])
                a, b = (wa.take(i), pa.array(na).take(i)), (wb.take(j), pa.array(nb).take(j))
                for one, other in ((a, b), (b, a)):
                    yield pa.RecordBatch.from_arrays([*one, *other], names=["word", "n", "near", "near_n"])

    return pairs.select("a", "b", "own").mapInArrow(run, NEAR)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): from each word that has a form, its forms followed to the last. A form is at least TIMES as frequent
    as its word, so chains are short and have no cycle; each round doubles the steps."""
    roots = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not roots.join(on, "root", "left_semi").limit(1).count():
            return roots
        roots = materialize(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, least_n: int = 5, every: int = EVERY) -> DataFrame:
    """The words of the texts with their near words: (word, form, root, n, n_near, form_n), one row a word.

    Words are those of vocabulary(). Two are near if they differ by exactly one inserted, deleted or replaced code point.
    A word's form is its most frequent near word (ties: the smallest in code-point order) if that is at least TIMES as
    frequent; else null, and form_n with it. root follows forms to the last, and is the word itself where it has none.

    No pair of words is left out: blocks hold all words that one edit can reach, large blocks are cut into chunks that all
    meet, and each candidate is verified on its code points. Empty tables, null and empty texts have no words. Words of any length
    are compared whole. Other columns are ignored.
    """
    spark = docs.sparkSession
    words = materialize(vocabulary(docs, id_col, text_col, least, least_n, every), "vocabulary")
    blocks = materialize(_blocks(words), "blocks")
    moves = F.explode(F.array(*(F.lit(m).cast("long") for m in _MOVES))).alias("move")
    met = blocks.select("key", "chunk", moves).withColumn("to", F.col("key") + F.col("move"))
    there = blocks.select(F.col("key").alias("to"), F.col("chunk").alias("to_chunk"))
    met = met.join(there, "to").filter("move <> 0 or chunk <= to_chunk")
    met = met.join(blocks.select("key", "chunk", F.col("words").alias("a")), ["key", "chunk"])
    met = met.join(blocks.select(F.col("key").alias("to"), F.col("chunk").alias("to_chunk"), F.col("words").alias("b")), ["to", "to_chunk"])
    met = met.select("key", "chunk", "to", "to_chunk", "a", "b", (F.col("move") == 0).alias("same_key")).withColumn("own", F.expr("same_key and chunk = to_chunk"))
    # As many tasks as a shuffle has: the products are the work, and the tables behind them are small.
    met = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "chunk", "to", "to_chunk")
    near = _near(met).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    )
    found = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    kept = F.col("form_n") >= F.col("n") * TIMES
    found = found.select(
        "word",
        F.when(kept, F.col("best.form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(kept, F.col("form_n")).alias("form_n"),
    )
    found = materialize(found, "forms")
    roots = _roots(found.filter("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
