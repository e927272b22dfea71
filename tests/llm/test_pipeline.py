"""The pipeline on small tables: planted cases, and every stage's decisions against plain Python."""

import collections
import random
import zlib

import brute
import numpy as np

import corpus_pipeline
from lectern.llm import decontaminate, language_id, tokens

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["kept", "row", "t", "id", "key", "fp", "node", "host", "text_key", "digest", "words"]


def _prose(r):
    vocab = [f"{a}{b}" for a in ("an", "er", "in", "ou", "st", "tion") for b in ("the", "on", "ing", "re", "ly", "ed")]
    stop = ["the", "of", "and", "to"]
    return lambda n: " ".join(r.choice(vocab) + r.choice(vocab) if k % 4 else r.choice(stop) for k in range(n))


def _write(spark, d, rows, items, extra=False):
    df = spark.createDataFrame(rows, DOCUMENTS)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(f"x{c}").alias(c) for c in CLASH])
    df.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")


def _stages(spark, d):
    """What each stage but the last keeps."""
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, d).cache()
        assert docs.columns == columns
        kept.append([(x.doc_id, x.text) for x in docs.collect()])
    return docs, kept


def test_stages(spark, tmp_path):
    r = random.Random(5)
    prose = _prose(r)
    good = [prose(80) for _ in range(30)]
    copies = [good[0], good[1].replace(good[1].split()[5], "other", 1)]
    items = [prose(20) for _ in range(3)]
    leaks = [f"{prose(40)} {x} {prose(40)}" for x in items]
    bad = ["too short", "### $$$ %%% " * 30, "x y " * 60, "漢字" * 50]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good + copies + leaks + bad)]
    d = str(tmp_path)
    _write(spark, d, rows, list(enumerate(items)))
    docs, kept = _stages(spark, d)
    kept = [{x[0] for x in k} for k in kept]
    clean = set(range(30))
    assert kept[0] == clean | {30, 31, 32, 33, 34} and kept[1] == kept[0]
    assert kept[2] == clean | {32, 33, 34} and kept[3] == clean
    packed = corpus_pipeline.run(spark, d).toPandas()
    assert set(packed.doc_id) == clean
    assert language_id.fit(docs).names == ("en", "und") and len(decontaminate.words(items[0])) == 20
    assert all(np.array_equal(x.sort_values("offset").offset, [0, *np.cumsum(x.sort_values("offset").length)[:-1]]) for _, x in packed.groupby("sequence_id"))


def _plain(rows, items):
    """(doc_id, text) after each stage, by loops over whole tables."""
    out = [[r for r in rows if brute.good(r[1])]]
    now = out[-1]
    # a source is a host if it has no slash; a host without a dot is its own domain
    judged = brute.posteriors([(r[2], r[1]) for r in now if r[2] is not None], [(r[1], None, (r[3] or "").lower(), (r[3] or "").lower(), None) for r in now])
    gone = {(r[1], r[3]) for r, j in zip(now, judged, strict=True) if not j[2]}
    out.append([r for r in now if (r[1], r[3]) not in gone])
    now = out[-1]
    first = brute.groups([r[0] for r in now], [r[1] for r in now])
    dropped = {r[0] for r, f in zip(now, first, strict=True) if r[0] is not None and f is not None and r[0] > f}
    out.append([r for r in now if r[0] not in dropped])
    out.append([r for r in out[-1] if all(brute.copies(r[1], x or "") is None for _, x in items)])
    return [sorted(((r[0], r[1]) for r in k), key=repr) for k in out]


def test_awkward_rows_against_brute_force(spark, tmp_path):
    """Null, empty, repeated, very long and near rows, in tables with columns of any name; and empty tables."""
    r = random.Random(20)
    prose = _prose(r)
    base = [prose(r.randrange(24, 70)) for _ in range(20)]
    items = [(0, prose(15)), (1, prose(40)), (2, None), (3, ""), (None, prose(12))]
    texts = list(base)
    for t in base[:12]:
        w = t.split()
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w[: r.choice([len(w), len(w) - 3])]))
    texts += [t.upper() for t in base[:3]] + [f"{prose(20)} {x} {prose(20)}" for _, x in items if x] + [f"{prose(20)} {items[1][1][:90]} {prose(20)}"]
    texts += [None, "", " \n\t", "short", prose(6000), "- " + prose(30), "…\n" + prose(30) + " ...", "xq zzvk qwrt the ppkx jjqz " * 9, "漢字 the 字 of " * 12]
    rows = [(i, t, r.choice(["en", "en", "EN", "de", None]) if i % 9 else None, r.choice(["a", "B", None]), None) for i, t in enumerate(texts)]
    rows += [(3, base[3], "en", "a", 1), (3, base[3], "en", "a", 1), (None, prose(40), "en", "a", None), (None, base[5], None, None, None), (500, base[0], "en", "b", 1)]
    d = str(tmp_path / "some")
    _write(spark, d, rows, items, True)
    _, kept = _stages(spark, d)
    want = _plain(rows, items)
    for name, got, k in zip(corpus_pipeline.STAGES, kept, want, strict=False):
        assert sorted(got, key=repr) == k, name[0]
    assert len(want[0]) > len(want[2]) > len(want[3]) > 10
    enc, packed = tokens.Encoder(tokens.default_path()).tok, corpus_pipeline.run(spark, d).toPandas()
    ids = collections.Counter()
    for i, t in want[3]:
        x = np.array([*enc.encode(t, add_special_tokens=False).ids, 2], "<u4")
        lead = len(x) - (-(-len(x) // 1024) - 1) * 1024
        cuts = [0, *range(lead, len(x) + 1, 1024)]
        ids.update((i, k, int(a), int(z - a), zlib.crc32(x[a:z].tobytes())) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)))
    none = lambda v: None if v != v else int(v)
    assert collections.Counter((none(x.doc_id), x.piece, x.start, x.length, x.ids_crc32) for x in packed.itertuples()) == ids
    assert all(list(x.offset) == [0, *np.cumsum(x.length)[:-1]] and x.length.sum() <= 1024 for _, x in packed.sort_values("offset").groupby("sequence_id"))
    empty = str(tmp_path / "none")
    _write(spark, empty, [], [])
    assert corpus_pipeline.run(spark, empty).count() == 0
