"""Line dedup, spelling variants and whitening against brute force and awkward tables."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import line_dedup, spelling, staging, whitening

CLASH = ["text", "id", "row", "h", "docs", "batch", "gone", "word", "n", "m", "first", "v", "x", "component", "n_lines", "__x"]
BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _clashing(df, but=()):
    return df.select("*", *[F.lit(1).alias(c) for c in CLASH if c not in df.columns and c not in but])


# line dedup -----------------------------------------------------------------------------------------------------------------


def _kept(rows, least, chars=1):
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    n = collections.Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < chars or n[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def _texts(seed=1, n=120):
    rng = random.Random(seed)
    lines = ["", "  ", "Ünder", "a b", " A B\t", "ÉA", "éa", "x" * 3000, " a b", "\r", "one", "two", "ONE "] + [f"line {k}" for k in range(60)]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 12)))) for k in range(n)]
    return [*rows, (None, "a b"), (None, None), (900, ""), (901, None), (902, "\n\n"), (7, "a b"), (7, "a b"), (903, "a b\n" * 20_000), (904, "z" * 300_000)]


@pytest.mark.parametrize("least,chars", [(10, 1), (2, 4), (1, 1)])
@pytest.mark.parametrize("keys", [line_dedup.BROADCAST_KEYS, 0])
def test_lines(spark, least, chars, keys):
    rows = _texts()
    docs = _clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = line_dedup.dedupe(docs, least=least, least_chars=chars, batches=5, broadcast_keys=keys)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "text"] and _rows(got) == _kept(rows, least, chars)
    assert line_dedup.dedupe(docs.limit(0), broadcast_keys=keys).count() == 0


def test_runs_stay_few_and_hold_all_counts(spark):
    """Nine batches: levels of a binary counter, settled keys not written again, the same keys as counted at once."""
    runs = line_dedup.LineRuns(spark, least=4)
    assert runs.frequent().count() == 0
    total, sizes = collections.Counter(), []
    for k in range(9):
        rows = [("always", 2), (f"own{k}", 1), (f"pair{k // 2}", 1), ("nine", 1)]
        total.update(dict(rows))
        runs.add(spark.createDataFrame(rows, "h string, docs long").select(F.col("h").cast("binary"), "docs"))
        sizes.append([level for level, _ in runs.runs])
    assert sizes[-1] == [3, 0] and max(map(len, sizes)) == 3
    newest = {bytes(r.h).decode() for r in spark.table(runs.runs[-1][1]).collect()}
    assert newest == {"own8", "pair4"}  # the others were settled before
    plan = runs._merged(runs.runs[0][1], runs.runs[1][1])._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan  # runs lie in the same buckets
    assert {bytes(r.h).decode() for r in runs.frequent().collect()} == {h for h, n in total.items() if n >= 4}
    held = {bytes(r.h).decode(): r.docs for r in runs.compact().collect()}
    assert set(held) == set(total) and all(min(held[h], 4) == min(n, 4) for h, n in total.items())
    runs.close()
    assert not runs.runs


def test_lines_in_sql(spark):
    """SQL and Spark on rows with copies, blanks and letters of every kind."""
    rows = [r for r in _texts(2) if r[0] is not None and r[0] != 7]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    want = sorted(c.execute(line_dedup.SQL["op11_line_runs"]).fetchall())
    got = sorted((r[0], r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in line_dedup.dedupe(docs).collect())
    assert [tuple(r) for r in want] == got


# spelling variants ----------------------------------------------------------------------------------------------------------


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _variants(rows, least_chars, least_n, ratio, every=None):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if every and h % every == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_chars and k >= least_n}
    form, out = {}, []
    near = {w: [x for x in n if _near(w, x)] for w in n}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def _words(seed, n, letters, sizes):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.choice(sizes))) for _ in range(n)]


@pytest.mark.parametrize("block", [2, 7, spelling.BLOCK])
def test_variants(spark, block):
    rng = random.Random(block)
    words = _words(1, 150, "ab", range(5, 9)) + _words(2, 150, "abcÉé", range(4, 8)) + _words(3, 20, "xyz", [30, 31, 300])
    words += [w[:-1] for w in words[-20:]] + [w[:7] + "q" + w[8:] for w in words[-20:]] + ["q" + w for w in words[-20:]]
    rows = [(k, " ".join(rng.choices(words, k=40)) + rng.choice(["", ".", "1", "×÷", "\x00", "œ"])) for k in range(60)]
    rows += [(None, "abababab" * 3), (61, None), (62, ""), (63, "aabab " * 70_000), (63, "aabab ABABA"), (64, "z" * 200_000), (65, "y" + "z" * 200_000)]
    docs = _clashing(spark.createDataFrame(rows, "doc_id long, text string"), but=("id",))
    for change, every in ((None, None), (spelling.slips(7), 7)):
        got = spelling.variants(docs, least_n=1, change=change, block=block)
        assert _rows(got) == _variants(rows, 5, 1, 2, every)
    got = spelling.variants(docs, least_chars=4, least_n=3, ratio=3, block=block)
    assert _rows(got) == _variants(rows, 4, 3, 3)
    assert spelling.variants(docs.limit(0)).count() == 0


def test_one_letter_blocks(spark):
    """More words than a block holds that differ in one letter only, and chains of forms."""
    letters = [chr(c) for c in [*range(97, 123), *range(0xE0, 0x100)]]
    rows = [(k, f"abc{x}def " * (3 + k)) for k, x in enumerate(letters)] + [(99, "abcdef " * 500), (100, "abcdeffff " * 3 + "abcdefff " * 9 + "abcdeff " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _rows(spelling.variants(docs, block=5)) == _variants(rows, 5, 3, 2)


def test_portions_end_outside_words(monkeypatch):
    monkeypatch.setattr(spelling, "AT_ONCE", 5)
    for text in ("abc défé ghi", "éééééééé", "日本語テキスト", "a" * 30, "ab\x00cd ef gh ij", "", "aœbœcœdœeœf", "éabc×d"):
        parts = list(spelling._portions(text.encode()))
        assert b"".join(parts) == text.encode()
        assert [w for p in parts for w in spelling.LETTERS.findall(p)] == spelling.LETTERS.findall(text.encode())


# whitening ------------------------------------------------------------------------------------------------------------------


def _white(rows, k=4, scale=256):
    rows = [(i, [None if c is None else np.float32(c) for c in v]) for i, v in rows if v is not None]
    rows = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in rows if len(v) == 6 and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in rows}), float)
    n, s = len(fit), [sum(int(v) for v in col) for col in fit.T]
    c = fit - np.array(s) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = {}
    for i, x in rows:
        y = (np.array(x) - np.array(s) / n) @ u / np.sqrt(e)
        out.setdefault(i, []).append((n, sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)), y, e / np.trace(v)))
    return out, e


def test_whitening(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(6, 6)) * [9, 5, 3, 1, 0.5, 0.1]
    rows = [(k, (rng.normal(size=6) @ mix.T).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[0][1]) for k in range(200)]  # a hot copy has the weight of one
    rows += [(400, None), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (402, [float("nan")] * 6), (403, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0]), (404, [3e38] * 6), (405, [1.0]), (406, []), (5, rows[5][1]), (None, rows[6][1]), (407, [-0.001] * 6)]
    vectors = _clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7), but=("id",))
    want, e = _white([r for r in rows if r[0] != 404])
    got = whitening.whiten(vectors).collect()
    assert {r.vec_id for r in got} == set(want) and len(got) == 4 * sum(map(len, want.values()))
    assert {r.component for r in got} == {1, 2, 3, 4} and len({(r.n, r.explained, r.identity_error) for r in got}) == 4
    assert all(r.identity_error < 1e-9 for r in got)
    sign = {}
    for r in got:
        n, deviation, y, share = want[r.vec_id][0]
        assert r.n == n and r.deviation == deviation and abs(r.explained - share[r.component - 1]) < 1e-12
        s = sign.setdefault(r.component, np.sign(r.whitened * y[r.component - 1]))
        assert abs(r.whitened * s - y[r.component - 1]) < 1e-8
    assert whitening.whiten(vectors.limit(0)).count() == 0 and whitening.whiten(vectors.filter("vec_id in (400, 406)")).count() == 0
    assert whitening.whiten(vectors.filter("vec_id >= 1000")).count() == 0  # all equal: nothing varies
    two = whitening.whiten(vectors.filter("vec_id in (1, 2)")).collect()
    assert {r.component for r in two} == {1} and all(abs(abs(r.whitened) - 1) < 1e-9 and r.explained > 1 - 1e-9 for r in two)


def test_whole_numbers_beyond_longs(spark):
    """Sums and squares that no long holds are exact, or fail; never wrong."""
    big = 2**40
    rows = spark.createDataFrame([(k, [float(big + k), float(-big * (k % 2))]) for k in range(8)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="[Oo]verflow|too large|fit"):
        whitening.whiten(rows, scale=1).collect()
    fit = whitening.fit_list(rows.select("embedding"), 2, 1)
    n, sums = whitening.totals(fit, 2)
    assert (n, sums) == (8, [8 * big + 28, -4 * big])
    x = np.array([[2**62, -(2**62)], [5, 7]])
    d = whitening._deviations(x, 3, [1, 2])
    assert whitening._square_sums(d) == [(3 * 2**62 - 1) ** 2 + (3 * 2**62 + 2) ** 2, 14**2 + 19**2]
    assert staging.materialize is not None
