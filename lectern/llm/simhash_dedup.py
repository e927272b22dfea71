"""SimHash near-duplicates by the generalised pigeonhole principle.

If two 64-bit fingerprints differ in at most ``tau`` bits and the bits lie in m partitions with thresholds t_1 ... t_m whose
sum is tau - m + 1, then in some partition i they differ in at most t_i bits (-1: the partition is not probed at all). So:

1. bits whose values go together over all fingerprints are put into one partition, which leaves the partitions as
   independent of each other as they can be;
2. for each number of partitions, thresholds are allocated by dynamic programming on the estimated number of candidate
   pairs and of probes; the cheapest allocation is used. Both statistics are taken over all distinct fingerprints;
3. a fingerprint probes a bucket for its partition's value (threshold 0), or one for each choice of t_i bits that are
   masked out; fingerprints that share a bucket are compared exactly.

Buckets are counted before they are dealt. One with more than ``BLOCK`` members is cut into blocks, and each pair of blocks
is a task's work of its own: no bucket lands in one task, and no candidate is left out. A task joins what it has verified
into trees, so a group of thousands of copies leaves it with a link for each member and not for each pair, and two blocks
with one that joins them.

For near-duplicates proper a link takes a Jaccard similarity of 0.8 of the sets of five-word shingles, which is computed from
the texts of the candidates. A sketch (MinHash) travels with each fingerprint and only says which pairs are not worth it: of
those with 0.8 less than one in 10,000. ``fingerprints`` then takes distinct words, whose fingerprints stay near where a few
words differ, and ``tau`` is 6. At a similarity of 0.8 some fingerprints are further apart than that, of few words more often than
of many, so the sketch is probed too, in ``BANDS`` bands of ``BAND`` positions: of pairs with 0.8, and texts of any length, two in
1,000 share none, and of those with more, fewer.

Texts without a word have fingerprint zero and are linked like any other; a null text is an empty one. Texts of any length are
hashed whole, a part of their shingles at a time. Rows with equal ids
or null ids are rows like any other; a component's id is its smallest id that is not null. Columns other than id and text
are ignored by ``components_of``; ``keep_one`` returns the input's columns. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.graph import components
from lectern.llm.staging import materialize, small_arrow, table, without
from lectern.llm.tokens import give_back, small_batches

SEED, BITS, BLOCK = 42, 64, 512
#: Relative costs of a probe that is shuffled and of a pair that is compared.
PROBE_COST, PAIR_COST = 2e-6, 1e-8
PERMUTATIONS, SIMILARITY = 128, 0.8
#: Shares of positions that agree: from the first on a pair is likelier near than not, and a tree takes the smallest node's first: groups
#: that have most of their rows in common then have most of their candidates in common, and a pair is verified once. From the second on
#: its members need no other link between them.
LIKELY, CERTAIN = 0.84, 0.95
#: Candidates for each row of a group that are verified one by one, a tree's; the rows of groups with more are compared where the group is.
#: A row is in a group for each probe, so this counts some twenty times over.
EVERY = 1
#: Bytes of shingles' hashes of a group's rows that one task compares, and columns of a matrix of them.
HELD, COLUMNS = 8 << 20, 2048
#: Positions of the sketch that make a bucket's key together, and how many such keys there are.
BAND, BANDS = 6, 21
#: Texts of candidates are found by a broadcast of at most so many keys.
BROADCAST_TEXTS = 1_000_000


@dataclass(frozen=True)
class Features:
    """What is hashed: shingles of ``words`` words, each occurrence or only distinct ones; ``sketch``: words of a sketch's shingles, 0 for none."""

    words: int = 3
    distinct: bool = False
    sketch: int = 0


CONTRACT = Features(3)
NEAR_DUPLICATES = Features(1, True, 5)


def _shingles(words: list[bytes], k: int) -> list[bytes]:
    if len(words) < k:
        return [b" ".join(words)] if words else []
    return words if k == 1 else list(map(b" ".join, zip(*[words[i:] for i in range(k)], strict=False)))


def _hashes(shingles: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))


def majority(h: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of ``h``."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[k : k + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1, 1 << 63, n, np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


_A, _B = _functions(PERMUTATIONS)
#: Positions that agree in a pair of the similarity at least, but for one pair in 10,000.
LOOSE = round(SIMILARITY * PERMUTATIONS - 4.1 * (SIMILARITY * (1 - SIMILARITY) * PERMUTATIONS) ** 0.5)


def minhash(h: np.ndarray) -> bytes:
    """A byte of the smallest value under each of the hash functions."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), 4096):
        x = h[k : k + 4096, None] * _A + _B
        least = np.minimum(least, (x ^ (x >> np.uint64(31))).min(0))
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def _worker(feat: Features):
    def run(batches):
        for b in small_batches(batches):
            fps, sketches = [], []
            for t in b.column(1).to_pylist():
                words = (t or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
                s = _shingles(words, feat.words)
                fps.append(majority(_hashes(list(set(s)) if feat.distinct else s)))
                if feat.sketch:
                    sketches.append(minhash(_hashes(list(set(_shingles(words, feat.sketch))))))
            cols, names = [b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"]
            if feat.sketch:
                cols, names = [*cols, pa.array(sketches, pa.binary()), b.column(2)], [*names, "sketch", "key"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def fingerprints(docs: DataFrame, id_col: str, text_col: str, feat: Features) -> DataFrame:
    """(id, fp, sketch, key) per row; fp as a signed long, key of the text."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`"), *([_key(text_col).alias("key")] if feat.sketch else []))
    return rows.mapInArrow(_worker(feat), "id long, fp long" + (", sketch binary, key long" if feat.sketch else ""))


def _key(text_col: str):
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


# partitions and thresholds ---------------------------------------------------------------------------------------------


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have both bits i and j, summed over all of them."""

    def run(batches):
        total = np.zeros((BITS, BITS))
        for b in batches:
            v = np.ascontiguousarray(b.column(0).to_numpy().view(np.uint64), "<u8")
            bits = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS, dtype=np.int32)), pa.array(total.astype(np.int64).ravel())], names=["k", "n"])

    rows = fps.select("fp").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n")).collect()
    both = np.zeros(BITS * BITS)
    for k, n in rows:
        both[k] = n
    return fps.count(), both.reshape(BITS, BITS)


def partitions(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` partitions of about equal width; each grows by the bit that goes most together with those it has."""
    p = both.diagonal() / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(m):
        width = len(left) // (m - k)
        part = [max(left, key=lambda i: (corr[i, left].sum(), -i))]
        left.remove(part[0])
        while len(part) < width:
            nxt = max(left, key=lambda i: (corr[i, part].sum(), -i))
            part.append(nxt)
            left.remove(nxt)
        out.append(sorted(part))
    return out


def _mask(bits) -> int:
    v = sum(1 << b for b in bits)
    return v - (1 << 64) if v >> 63 else v


def equal_pairs(fps: DataFrame, parts: list[list[int]]) -> list[float]:
    """For each partition the number of pairs that agree in it, counted over all fingerprints."""
    values = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("v")) for i, p in enumerate(parts)])
    counts = fps.select(F.explode(values).alias("x")).groupBy("x.i", "x.v").agg(F.count("*").alias("c"))
    rows = counts.groupBy("i").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("n")).collect()
    found = {r["i"]: r["n"] for r in rows}
    return [found.get(i, 0.0) for i in range(len(parts))]


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = ``budget`` of the least total cost; ``costs[i][t]``."""
    best = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, len(row)):
                u = used + t + 1
                if u <= budget:
                    c = (cost + (row[t] if t >= 0 else 0.0), [*chosen, t])
                    if u not in nxt or c[0] < nxt[u][0]:
                        nxt[u] = c
        best = nxt
    return best.get(budget, (float("inf"), []))


def probes(fps: DataFrame, tau: int) -> list[tuple[int, ...]]:
    """The sets of bits whose values are bucket keys, for the cheapest partitioning and allocation."""
    n, both = bit_counts(fps)
    split = {m: partitions(n, both, m) for m in sorted({2, 3, 4, tau + 1}) if m <= tau + 1}
    flat = [p for parts in split.values() for p in parts]
    pairs = iter(equal_pairs(fps, flat))
    p = both.diagonal() / max(n, 1)
    differ = 2 * p * (1 - p)  # two fingerprints taken at random differ in a bit
    found = []
    for parts in split.values():
        costs = []
        for bits in parts:
            same = max(next(pairs), n * n / 2 * float(np.prod(1 - differ[bits])))
            row = []
            for t in range(min(tau, 2) + 1):
                masked = list(combinations(bits, t))
                candidates = sum(same / max(float(np.prod(1 - differ[list(x)])), 1e-9) for x in masked)
                # a bucket of c members that is cut into blocks is shuffled c / BLOCK times over: 2 / BLOCK rows for each of its pairs
                row.append(PROBE_COST * n * len(masked) + (PAIR_COST + PROBE_COST * 2 / BLOCK) * candidates)
            costs.append(row)
        cost, chosen = allocate(costs, tau + 1)
        keys = [tuple(b for b in bits if b not in x) for bits, t in zip(parts, chosen, strict=False) if t >= 0 for x in combinations(bits, t)]
        found.append((cost, keys))
    return min(found, key=lambda x: x[0])[1]


# probing and verifying ------------------------------------------------------------------------------------------------


class _Forest:
    """Rows that are joined into trees; ``label`` says for each row which tree it is of."""

    def __init__(self, label: np.ndarray):
        self.parent, self.label = label.tolist(), label

    def top(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Join rows ``a`` with rows ``b``; returns which of these made one tree of two."""
        made = []
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            r, s = self.top(x), self.top(y)
            if r != s:
                self.parent[max(r, s)] = min(r, s)
                made.append(k)
        label = np.array(self.parent)
        while (label != label[label]).any():
            label = label[label]
        self.label = label
        return made


def _whole(batches):
    """Tables of whole groups (gid), as rows come sorted by them."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([*(held.to_batches() if held is not None else []), b]).combine_chunks()
        gid = t.column("gid").to_numpy()
        last = int(np.searchsorted(gid, gid[-1]))  # the last group may go on in the next batch
        if last:
            yield t.slice(0, last)
        held = t.slice(last).combine_chunks()
    if held is not None:
        yield held
    give_back()


def _sketches(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, PERMUTATIONS)


def _verifier(tau: int, sketched: bool, every: int):
    likely, certain = round(LIKELY * PERMUTATIONS), round(CERTAIN * PERMUTATIONS)

    def linked(gid, node, side, fp, sketch):
        """Links that join whatever is near within a group, as trees. With sketches these are candidates: all pairs that may be near,
        or, where a group has more than ``every`` of them a row, trees of the likeliest, and the group's rows to be looked at
        again. Pairs of one side of a group that joins two blocks are none: those are in a group of their own."""
        n = len(gid)
        ends = np.flatnonzero(np.diff(gid)) + 1
        begins, ends = np.concatenate([[0], ends]), np.concatenate([ends, [n]])
        group = np.repeat(np.arange(len(begins)), ends - begins)
        stop = ends[group]
        forest, out = _Forest(np.arange(n)), []
        inner = lambda a, b: (side[a] >= 0) & (side[a] == side[b])
        left: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at, lag = np.arange(n), 0
        while True:
            lag += 1
            at = at[at + lag < stop[at]]
            if not len(at):
                break
            near = np.bitwise_count(fp[at] ^ fp[at + lag]) <= tau
            a = at[near | (gid[at] & 1 == 1)] if sketched else at[near]
            a = a[forest.label[a] != forest.label[a + lag]]
            if sketched and len(a):
                agree = (sketch[a] == sketch[a + lag]).sum(1)
                some = (agree >= LOOSE) & (agree < certain)
                left.append((a[some], a[some] + lag, agree[some]))
                a = a[agree >= certain]
            if len(a):
                made = forest.join(a, a + lag)
                out += [(x, x + lag) for x in a[made][~inner(a[made], a[made] + lag)].tolist()]
        dense = np.zeros(len(begins), bool)
        if left:
            a, b, agree = (np.concatenate(x) for x in zip(*left, strict=True))
            cross = forest.label[a] != forest.label[b]
            a, b, agree = a[cross], b[cross], agree[cross]
            own = inner(a, b)
            dense = np.bincount(group[a[~own]], minlength=len(begins)) > every * (ends - begins)
            many = dense[group[a]]
            out += list(zip(a[~own & ~many].tolist(), b[~own & ~many].tolist(), strict=True))
            a, b, agree, own = a[many], b[many], agree[many], own[many]
            order = np.lexsort((-agree, a, agree < likely, ~own))
            for k in range(0, len(order), 4096):
                e = order[k : k + 4096]
                e = e[forest.label[a[e]] != forest.label[b[e]]]
                if len(e):
                    e = e[forest.join(a[e], b[e])]
                    e = e[~own[e]]
                    out += list(zip(a[e].tolist(), b[e].tolist(), strict=True))
        e, again = np.array(out, np.int64).reshape(-1, 2), np.flatnonzero(dense[group])
        none = lambda k, kind: pa.nulls(k, kind)
        both = lambda x, y: pa.concat_arrays([x, y])
        cols, names = [pa.array(np.concatenate([node[e[:, 0]], node[again]])), both(pa.array(node[e[:, 1]]), none(len(again), pa.int64()))], ["u", "v"]
        if sketched:
            rows = {"gid": pa.array(gid[again]), "fp": pa.array(fp[again].view(np.int64)), "sketch": pa.array([x.tobytes() for x in sketch[again]], pa.binary())}
            cols, names = [*cols, *(both(none(len(e), x.type), x) for x in rows.values())], [*names, *rows]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches):
        for t in _whole(batches):
            yield linked(*(t.column(c).to_numpy() for c in ("gid", "node", "side")), t.column("fp").to_numpy().view(np.uint64), _sketches(t) if sketched else None)

    return run


def links(nodes: DataFrame, tau: int, sketched: bool, block: int = BLOCK) -> DataFrame:
    """(u, v): verified links that connect whatever is connected; if ``sketched``, candidates for these, and with gid, fp and
    sketch and no v the rows of groups that are to be looked at again. ``nodes``: node, fp and, if ``sketched``, sketch. Then the last bit of
    a bucket's and a group's number says whether it is one of bands, whose pairs may be any distance apart."""
    keys = probes(nodes, tau)
    probed = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_mask(k)))) for i, k in enumerate(keys)])
    if sketched:
        bands = F.array(*[F.xxhash64(F.lit(-1 - i), F.substring("sketch", BAND * i + 1, BAND)) for i in range(BANDS)])
        probed = F.concat(F.transform(probed, lambda x: x.bitwiseAND(F.lit(-2))), F.transform(bands, lambda x: x.bitwiseOR(F.lit(1))))
    bucket = F.explode(probed).alias("bucket")
    counts = nodes.select(bucket).groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    extra = ["sketch"] if sketched else []
    if sketched:  # a sketch is wide, and most buckets have one row: which are met is found without it
        met = materialize(nodes.select("node", bucket).join(counts, "bucket"), "met").join(nodes.select("node", "fp", "sketch"), "node")
    else:
        met = nodes.select("node", "fp", bucket).join(counts, "bucket")
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(1)), blocks)
    # a group for each pair of blocks, of two sides, and for each block with itself
    number = lambda h: h.bitwiseAND(F.lit(-2)).bitwiseOR(F.col("bucket").bitwiseAND(F.lit(1))) if sketched else h
    pair = lambda b: F.struct(number(F.xxhash64("bucket", F.least(b, mine), F.greatest(b, mine))).alias("gid"), F.when(b == mine, -1).when(b > mine, 0).otherwise(1).alias("side"))
    whole = F.array(F.struct(F.col("bucket").alias("gid"), F.lit(-1).alias("side")))
    met = met.select("node", "fp", *extra, F.explode(F.when(F.col("n") > block, F.transform(F.sequence(F.lit(0), blocks - 1), pair)).otherwise(whole)).alias("g"))
    return _dealt(met.select("g.gid", "g.side", "node", "fp", *extra)).mapInArrow(_verifier(tau, sketched, EVERY), "u long, v long" + (", gid long, fp long, sketch binary" if sketched else ""))


def _dealt(rows: DataFrame) -> DataFrame:
    """Each group (gid) in one task, one after the other."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "gid").sortWithinPartitions("gid", "node")


def similar_components(nodes: DataFrame, tau: int, docs: DataFrame, text_col: str, feat: Features) -> DataFrame:
    """(node, root): components of the links between sets of shingles that are as similar as they must be.

    A first pass gives candidates, a bounded number for each row of a group, whose sets are brought together. Where a group has more,
    these are trees of its likeliest pairs, and rows with candidates that are still apart are compared in full by the task that has the
    group, which hands on a link for each two components that it joined. So no pair that is not near becomes a row, however
    many a group has of them."""
    found = materialize(links(nodes, tau, True), "near")
    with small_arrow(nodes.sparkSession):
        roots = components(materialize(verified(materialize(_pairs(found), "tested"), nodes, docs, text_col, feat), "links"))
        again = found.filter("gid is not null").withColumnRenamed("u", "node").join(roots, "node", "left")
        again = again.select("gid", "node", F.coalesce("root", "node").alias("comp"), "fp", "sketch")
        again = materialize(_dealt(again).mapInArrow(_apart(tau), "gid long, node long, comp long"), "again")
        if again.isEmpty():
            return roots
        sets = materialize(shingles(again.select("node").distinct(), nodes, docs, text_col, feat), "shingles")
        new = materialize(_compared(again, sets), "links")
        return roots if new.isEmpty() else components(roots.toDF("u", "v").unionByName(new))


def _compared(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): links that join what is near within a group. ``rows``: gid, node and the component that it is known to be of; ``sets``:
    (node, shingles). A group of more than ``HELD`` bytes is cut into parts, and each pair of parts is a group."""
    size = rows.join(sets.select("node", F.length("shingles").alias("size")), "node").groupBy("gid").agg(F.sum("size").alias("size"))
    parts = size.select("gid", F.greatest(F.lit(1), F.ceil(F.col("size") / HELD)).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.xxhash64("gid", F.least(p, mine), F.greatest(p, mine)))
    rows = rows.join(parts, "gid").select(F.explode(F.when(F.col("parts") > 1, pairs).otherwise(F.array("gid"))).alias("gid"), "node", "comp")
    return _dealt(rows.join(sets, "node").select("gid", "node", "comp", "shingles")).mapInArrow(_joined, "u long, v long")


def _alike(sets: list[np.ndarray]) -> np.ndarray:
    """Of each two of ``sets`` of hashes whether they are as similar as they must be."""
    size = np.array([len(x) for x in sets])
    h, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(h)
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    shared = ~new  # what one set has alone is in no intersection
    shared[:-1] |= ~new[1:]
    row, column = row[shared], np.cumsum(new[shared]) - 1
    both = np.zeros((len(sets), len(sets)), np.float32)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        at = slice(*np.searchsorted(column, (k, k + COLUMNS)))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[row[at], column[at] - k] = 1
        both += m @ m.T
    return both >= SIMILARITY * (size[:, None] + size - both.astype(np.float64))


def _apart(tau: int):
    """Rows (gid, node, comp) that have a candidate of another component in their group."""

    def run(batches):
        for t in _whole(batches):
            gid, comp, fp = (t.column(c).to_numpy() for c in ("gid", "comp", "fp"))
            fp, sketch = fp.view(np.uint64), _sketches(t)
            stop = np.searchsorted(gid, gid, side="right")
            some = np.zeros(len(gid), bool)
            at, lag = np.arange(len(gid)), 0
            while True:
                lag += 1
                at = at[at + lag < stop[at]]
                if not len(at):
                    break
                a = at[comp[at] != comp[at + lag]]
                a = a[(gid[a] & 1 == 1) | (np.bitwise_count(fp[a] ^ fp[a + lag]) <= tau)]
                a = a[(sketch[a] == sketch[a + lag]).sum(1) >= LOOSE]
                some[a] = some[a + lag] = True
            yield from t.select(["gid", "node", "comp"]).filter(pa.array(some)).to_batches()

    return run


def _joined(batches):
    for t in _whole(batches):
        gid, node, comp = (t.column(c).to_numpy() for c in ("gid", "node", "comp"))
        begins = np.flatnonzero(np.diff(gid, prepend=~gid[:1]))
        u, v = [], []
        for i, j in zip(begins, [*begins[1:], len(gid)], strict=True):
            label = np.unique(comp[i:j], return_index=True, return_inverse=True)
            forest = _Forest(label[1][label[2]])
            if len(label[0]) == 1:  # a pair of parts of a group
                continue
            a, b = np.nonzero(np.triu(_alike([np.frombuffer(x, np.uint64) for x in t.column("shingles").slice(i, j - i).to_pylist()]), 1))
            for k in range(0, len(a), 4096):
                x, y = a[k : k + 4096], b[k : k + 4096]
                cross = forest.label[x] != forest.label[y]
                x, y = x[cross], y[cross]
                if len(x):
                    made = forest.join(x, y)
                    u.append(node[i:j][x[made]])
                    v.append(node[i:j][y[made]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (u, v)], names=["u", "v"])


def _pairs(found: DataFrame) -> DataFrame:
    return found.filter("v is not null").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _similar(batches):
    for b in small_batches(batches):
        a, c = ([np.frombuffer(x, np.uint64) for x in b.column(k).to_pylist()] for k in (2, 3))
        both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, c, strict=True)]
        yield b.filter(pa.array([n >= SIMILARITY * (len(x) + len(y) - n) for n, x, y in zip(both, a, c, strict=True)], pa.bool_())).select([0, 1])


def _texts(ends: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(node, t): a text of each of ``ends`` (node)."""
    asked = materialize(nodes.join(ends, "node").select("node", "key"), "asked")
    few = asked.count() <= BROADCAST_TEXTS
    texts = docs.select(_key(text_col).alias("key"), F.col(f"`{text_col}`").alias("t")).join(F.broadcast(asked) if few else asked, "key")
    return texts.groupBy("node").agg(F.first("t").alias("t"))


def shingles(ends: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, feat: Features) -> DataFrame:
    """(node, shingles): the hashes of the different shingles of each of ``ends`` (node)."""

    def run(batches):
        for b in small_batches(batches):
            found = [_hashes(list(set(_shingles((t or "").encode("utf-8", "surrogatepass").lower().split(), feat.sketch)))).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["node", "shingles"])

    return _texts(ends, nodes, docs, text_col).mapInArrow(run, "node long, shingles binary")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, feat: Features) -> DataFrame:
    """The pairs whose texts have a Jaccard similarity of ``SIMILARITY``. ``nodes``: node and the key of a text of it."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    found = materialize(shingles(ends, nodes, docs, text_col, feat), "shingles")
    met = pairs.join(found.toDF("u", "a"), "u").join(found.toDF("v", "b"), "v").select("u", "v", "a", "b")
    return met.mapInArrow(_similar, "u long, v long")


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 3, feat: Features = CONTRACT) -> DataFrame:
    """Per row: id, fingerprint, component_id."""
    rows = fingerprints(docs, id_col, text_col, feat)
    sketched = feat.sketch > 0
    rows = materialize(rows.withColumn("node", F.xxhash64("fp", "sketch") if sketched else F.col("fp")), "fingerprints")
    extra = [F.min("sketch").alias("sketch"), F.min("key").alias("key")] if sketched else []
    nodes = materialize(rows.groupBy("node", "fp").agg(F.min("id").alias("least"), *extra), "nodes")
    found = similar_components(nodes, tau, docs, text_col, feat) if sketched else components(links(nodes, tau, False).select("u", "v"))
    rooted = nodes.join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")  # apart from the join, so that Spark can split the join
    named = rooted.join(ids, "root").select("node", "component_id")
    return rows.join(named, "node").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 6, feat: Features = NEAR_DUPLICATES) -> DataFrame:
    """Of each group of near-duplicates the rows with its smallest id, with the input's columns. A row goes if its id is the
    id of a row that is not its group's smallest; rows without an id stay."""
    found = components_of(docs, id_col, text_col, tau, feat)
    return without(docs, F.col(f"`{id_col}`"), found.filter(F.col(id_col) > F.col("component_id")).select(id_col))


# the query ------------------------------------------------------------------------------------------------------------


def op6_simhash_components(spark, sf_dir):
    return components_of(table(spark, sf_dir, "documents"))


QUERIES = {"op6_simhash_components": op6_simhash_components}
SQL: dict[str, str] = {}
