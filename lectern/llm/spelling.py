"""Spelling variant grouping: forward and reversed sorted dictionaries, in which one edit leaves a half of a word intact.

Words are maximal runs of letters (A-Z, a-z and U+00C0 to U+00FF), A-Z in lower case, counted over all documents; those of at
least ``least_chars`` code points and ``least_n`` occurrences make the dictionary. To have variants in a corpus that has none,
``slips`` says which occurrences lose a letter, by a checksum of document and word.

Two words of which the shorter has m letters and that one insertion, deletion or replacement parts share their first m // 2
letters or their last. So every word stands in the forward dictionary under its first letters and in the reversed one under
its last, once as the shorter and once as the longer of two. A block is a range of equal keys in such a sorted dictionary. A
block of more than ``BLOCK`` words is subdivided by the same law: behind what its words share, one edit leaves the first or
the last half of the rest intact, so the block is parted by either half, again and again, until it is small enough or its
words differ in one letter, of which there are as many as the alphabet has. No pair is lost by that, and none is looked at
but within blocks. Blocks are range-scanned: dealt by key ranges, sorted, and compared letter by letter where they lie. What
leaves a task are pairs of near words, which are as many as the words have neighbours.

A word's form is its near word of largest n (ties: the smaller in code-point order) if that is at least ``ratio`` times the
word's n. Forms lead to ever larger n, so they are trees; roots are found by doubling pointers, a join a round, and rounds grow
with the logarithm of the depth, which itself is at most the logarithm of the largest n.

Null and empty texts have no words; texts of any length are processed whole, some megabytes at a time, and words of any length
are words. Repeated rows count each; a null id counts as an empty one in the checksum. Other columns than id and text are
ignored. Empty tables give empty results. Each word has one row, so ties are those of forms.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.staging import materialize, table
from lectern.llm.tokens import small_batches

#: Runs of letters in UTF-8, in which U+00C0 to U+00FF are two bytes, and what is none.
LETTERS, OTHERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+"), re.compile(rb"(?:[^A-Za-z\x80-\xff]|[\xc2\xc4-\xf4][\x80-\xbf]+)")
#: Words of a block that are compared with one another; blocks beyond it are subdivided.
BLOCK = 96
#: Bytes of text counted at a time; bytes of letters compared at a time.
AT_ONCE, COMPARED = 4 << 20, 4 << 20
#: Blocks beyond ``BLOCK`` that are broadcast; their number is counted first.
BROADCAST_BLOCKS = 100_000


def slips(every: int = 97):
    """An occurrence loses one letter if the CRC-32 of ``<id>:<word>`` is divisible by ``every``: the one at that number modulo
    the word's length."""

    def change(doc: bytes, word: bytes) -> bytes:
        h = zlib.crc32(doc + b":" + word)
        if h % every:
            return word
        letters = word.decode()
        at = h % len(letters)
        return (letters[:at] + letters[at + 1 :]).encode()

    return change


def _portions(text: bytes):
    """A long text in portions that end outside words."""
    at = 0
    while len(text) - at > AT_ONCE:
        end = OTHERS.search(text, at + AT_ONCE)
        if not end:
            break
        yield text[at : end.start()]
        at = end.start()
    yield text[at:]


def dictionary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_n: int = 3, change=None) -> DataFrame:
    """(word, n), written down. Words are counted where a document was read; what is shuffled is a row for each word of some
    megabytes."""

    def run(parts):
        for b in small_batches(parts, AT_ONCE):
            n: Counter[bytes] = Counter()
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                for portion in _portions(text or b""):
                    own = Counter(LETTERS.findall(portion.lower()))
                    if change is None:
                        n.update(own)
                    else:
                        doc_b = (doc or "").encode()
                        for word, k in own.items():
                            n[change(doc_b, word)] += k
            words = pa.array(list(n), pa.binary()).cast(pa.string())
            long_enough = pc.greater_equal(pc.utf8_length(words), least_chars)
            yield pa.RecordBatch.from_arrays([words.filter(long_enough), pa.array(list(n.values()), pa.int64()).filter(long_enough)], names=["word", "n"])

    texts = docs.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"))
    counts = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(counts.filter(F.col("n") >= least_n), "dictionary")


# blocks ---------------------------------------------------------------------------------------------------------------

#: What a block shares: letters of the shorter word, first and last letters that are fixed, and these letters.
KEY = ["m", "a", "b", "first", "last"]


def _halves(rows: DataFrame) -> DataFrame:
    """Rows of blocks under the keys of the two halves of what their words do not share yet."""
    half = F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    sides = F.explode(F.array(F.struct((F.col("a") + half).alias("a"), F.col("b")), F.struct(F.col("a"), (F.col("b") + half).alias("b"))))
    out = rows.select("word", "n", "m", sides.alias("s")).select("word", "n", "m", "s.a", "s.b")
    return out.withColumns({"first": F.left("word", F.col("a")), "last": F.right("word", F.col("b"))})


def small_blocks(words: DataFrame, least_chars: int, block: int = BLOCK) -> list[DataFrame]:
    """Tables of rows (word, n, key) whose blocks are of ``block`` words at most or cannot be parted."""
    size = F.char_length("word")
    roles = F.explode(F.filter(F.array(size, size - 1), lambda m: m >= least_chars))
    rows = materialize(_halves(words.select("word", "n", roles.alias("m"), F.lit(0).alias("a"), F.lit(0).alias("b"))), "blocks")
    out = []
    while True:
        large = materialize(rows.filter("m - a - b > 1").groupBy(*KEY).count().filter(F.col("count") > block).drop("count"), "large-blocks")
        many = large.count()
        if not many:
            return [*out, rows]
        side = F.broadcast(large) if many <= BROADCAST_BLOCKS else large
        out.append(rows.join(side, KEY, "left_anti"))
        rows = materialize(_halves(rows.join(side, KEY, "left_semi")), "blocks")


def _compare(letters: np.ndarray, sizes: np.ndarray, m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i: m letters, j: m or m + 1) one edit parts. ``letters``: a row of m + 1 for each word."""
    out = np.zeros(len(i), bool)
    step = max(1, COMPARED // (m + 1))
    for at in range(0, len(i), step):
        p, q = i[at : at + step], j[at : at + step]
        a, b = letters[p], letters[q]
        same = a[:, :m] == b[:, :m]
        # an insertion: equal up to a place, and from there on one letter later
        later = a[:, :m] == b[:, 1:]
        first = np.where(same.all(1), m, same.argmin(1))
        last = np.where(later.all(1), -1, m - 1 - later[:, ::-1].argmin(1))
        out[at : at + step] = np.where(sizes[q] == m, (~same).sum(1) == 1, last < first)
    return out


def _near_in(words: list[bytes], m: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of near words within blocks, the shorter or smaller first. Rows are sorted by block, size and word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    ends = np.repeat(np.append(starts[1:], len(words)), np.diff(np.append(starts, len(words))))
    left, right = [], []
    for size in np.unique(m):
        rows = np.flatnonzero(m == size)
        letters = np.frombuffer(b"".join(words[r].ljust(size + 1, b"\0") for r in rows), np.uint8).reshape(len(rows), size + 1)
        # two words of m + 1 letters are compared where they are the shorter ones
        counts = np.where(sizes[rows] == size, ends[rows] - 1 - rows, 0)
        upto, at = np.cumsum(counts), 0
        while at < len(rows):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 1_000_000, side="right")))
            c = counts[at:stop]
            i = np.repeat(np.arange(at, stop), c)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
            ok = _compare(letters, sizes[rows], int(size), i, j)
            left.append(rows[i[ok]])
            right.append(rows[j[ok]])
            at = stop
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _scan(parts):
    """Range-scan: rows come sorted, a block is a stretch of equal keys. A stretch that a batch cuts waits for the next."""
    held: pa.Table | None = None
    for b in [*_each(parts), None]:
        got = held if b is None else pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        held = None
        if got is None or not got.num_rows:
            continue
        got = got.combine_chunks()
        code = np.zeros(got.num_rows, np.int64)
        new = np.zeros(got.num_rows, bool)
        for name in KEY:
            c = got[name].chunk(0)
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        code = np.cumsum(new)
        if b is not None:
            cut = int(np.searchsorted(code, code[-1]))
            held, got, code = got.slice(cut), got.slice(0, cut), code[:cut]
            if not cut:
                continue
        words = [w.encode("latin-1") for w in got["word"].to_pylist()]
        i, j = _near_in(words, got["m"].to_numpy(), code)
        i, j = pa.array(i), pa.array(j)
        pairs = pa.table([got["word"].take(i), got["n"].take(i), got["word"].take(j), got["n"].take(j)], names=["word", "n", "near", "near_n"]).combine_chunks()
        yield from pairs.to_batches()


def _each(parts):
    yield from parts


def near_words(words: DataFrame, least_chars: int = 5, block: int = BLOCK) -> DataFrame:
    """(word, n, near, near_n): each pair of words of the dictionary that one edit parts, once in each direction, written down."""
    spark = words.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = small_blocks(words, least_chars, block)
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    # a word alone in its block has no one to be compared with
    rows = materialize(rows, "all-blocks").withColumn("size", F.char_length("word"))
    sorted_rows = rows.repartitionByRange(shards, *KEY).sortWithinPartitions(*KEY, "size", "word")
    pairs = sorted_rows.mapInArrow(_scan, "word string, n long, near string, near_n long").distinct()
    both = F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return materialize(pairs.select(both.alias("p")).select("p.*"), "near-words")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), following forms to the last."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        step = materialize(now.join(onward, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if not step.filter("moved").limit(1).count():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_n: int = 3, ratio: int = 2, change=None, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the dictionary."""
    words = dictionary(docs, id_col, text_col, least_chars, least_n, change)
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    near = near_words(words, least_chars, block).groupBy("word").agg(F.count("*").alias("n_near"), best)
    found = -F.col("best.minus") >= ratio * F.col("n")
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(found, F.col("best.near")).alias("form"), F.when(found, -F.col("best.minus")).alias("form_n"))
    out = materialize(out, "forms")
    return out.join(roots(out.filter("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# the query ------------------------------------------------------------------------------------------------------------


def op12_spelling_variants(spark, sf_dir):
    return variants(table(spark, sf_dir, "documents"), change=slips())


#: CRC-32 in SQL: a table of 256 by its polynomial, and one step a byte.
_CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(list_concat([b::BIGINT], list_transform(range(8), lambda k: k::BIGINT)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END))"
_SQL = rf"""
WITH RECURSIVE t AS (SELECT {_CRC_TABLE} AS codes),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)),
own AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL),
hex AS (SELECT *, hex(encode(doc_id || ':' || run)) AS x FROM own),
crc AS (SELECT doc_id, run, k, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, length(x), 2), lambda i: ('0x' || x[i + 1 : i + 2])::BIGINT)),
 lambda c, b: xor(codes[xor(c, b) % 256 + 1], c // 256))) AS h FROM hex, t),
slipped AS (SELECT k, CASE WHEN h % 97 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word FROM crc),
words AS (SELECT word, sum(k)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, n, i, word[: i - 1] || word[i + 1 :] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
 SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
 UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
 UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min({{'minus': -near_n, 'near': near}}) AS best FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.minus >= 2 * n THEN best.near END AS form, CASE WHEN -best.minus >= 2 * n THEN -best.minus END AS form_n FROM words w LEFT JOIN best ON w.word = best.word),
walk AS (SELECT word, word AS root, form AS onward FROM forms UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN forms f ON f.word = walk.onward)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM forms f JOIN walk ON walk.word = f.word WHERE walk.onward IS NULL"""

QUERIES = {"op12_spelling_variants": op12_spelling_variants}
SQL = {"op12_spelling_variants": _SQL}
