"""Texts that were decoded by a wrong code page, once or several times, put right.

A text's cost is its negative log-likelihood under bigrams of character classes, each character costing the size of its class
besides. Between encodings of bytes Latin letters count one by one, as code pages differ in which letter of a class a byte is, and
letters beyond ASCII, with what stands close behind them, by up to ``BEHIND`` characters ahead as far as such were seen: one byte
may be all that tells two code pages apart. Bigrams and longer stretches are counted over a corpus in Spark (``fit``); they are
tables of ``SIGNS`` x ``SIGNS`` and of ``SLOTS`` numbers at most, whatever the corpus. ``repaired`` looks
for the cheapest text that some chain of undone decodings leads to, the cheapest first, and takes it only if it is cheaper by
``MARGIN``: sound text costs more after any decoding that it stands, so it stays as it is. A decoding counts as undone only if it
gives every byte back. Null stays null, pure ASCII is sound.
"""

from __future__ import annotations

import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.slices import cut, sliced

CLASSES = 16
#: Characters that count one by one, and with the classes of all others; how often a bigram of classes counts as seen in each letter.
LETTERS = 0x250
SIGNS, PRIOR = LETTERS + CLASSES, 20.0
#: Characters ahead of one that are looked at where Latin letters beyond ASCII stand; hashed counts of such stretches; how often what
#: fewer characters say counts as seen.
BEHIND, SLOTS, TRUST = 4, 1 << 22, 2.0
#: What stands ahead of a text.
START = "\n" * (BEHIND - 1) + " "
#: Chains of at most so many decodings, of which so many texts are looked at; nats by which a text must be cheaper.
DEPTH, LOOKED_AT, MARGIN = 3, 40, 2.0
#: What was taken for what: a text encoded by the first and decoded by the second is one step back.
STEPS = (("cp1252", "utf-8"), ("latin-1", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"), ("cp1252", "cp949"), ("latin-1", "cp949"))


def _class_of(c: int) -> int:
    ch = chr(c)
    if c < 128:
        return 0 if ch in "\n\t\r" else 1 if c < 32 or c == 127 else 2 if ch == " " else 3 if ch.islower() else 4 if ch.isupper() else 5 if ch.isdigit() else 6
    if c < 160:
        return 7  # controls that no text has
    kind = unicodedata.category(ch)
    if c < 0x180:
        return 8 if kind == "Ll" else 9 if kind == "Lu" else 10
    if 0xAC00 <= c < 0xD7A4:
        return 11
    if 0x2010 <= c <= 0x2026 or 0x20A0 <= c < 0x20C0:
        return 12
    if 0xE000 <= c < 0xF900 or c == 0xFFFD:
        return 15
    return 13 if kind[0] == "L" else 14


_TABLE = np.array([14 if 0xD800 <= c < 0xE000 else _class_of(c) for c in range(1 << 16)], np.int8)
_SIZE = np.log(np.bincount(_TABLE, minlength=CLASSES).clip(1))
#: Windows' code page, with the bytes that it leaves open as they are.
_OPEN = {b: chr(b) for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_SLOPPY = {chr(b) if b in _OPEN else bytes([b]).decode("cp1252"): b for b in range(256)}


_CLASS_OF_SIGN = np.concatenate([_TABLE[:LETTERS], np.arange(CLASSES)]).astype(np.int64)


def classes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(c < 1 << 16, _TABLE[np.minimum(c, (1 << 16) - 1)], 14).astype(np.int64)


def signs(text: str) -> np.ndarray:
    """Latin letters and ASCII by their codes, all else by class."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(c < LETTERS, c, LETTERS + classes(text)).astype(np.int64)


def _marked(c: np.ndarray) -> np.ndarray:
    """Which signs are Latin letters beyond ASCII."""
    return (c >= 128) & (c < LETTERS)


def _near(c: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places where a marked letter stands, or stood up to ``BEHIND`` signs ahead; so many signs are ahead of the first."""
    n = np.concatenate([[0], np.cumsum(_marked(c))])
    return at[n[at + 1] > n[at - BEHIND]]


def _slot(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15) + last.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) & np.uint64(SLOTS - 1)).astype(np.int64)


def _stretches(c: np.ndarray, at: np.ndarray):
    """For 2 to ``BEHIND`` signs ahead of places: (slot of these and the place's own, slot of these, whether a marked letter is among
    them, whether the place counts). Behind signs without a marked letter only such letters count."""
    h, met, own = np.zeros(len(at), np.uint64), np.zeros(len(at), bool), _marked(c[at])
    for k in range(1, BEHIND + 1):
        ahead = c[at - k]
        h = h * np.uint64(0xD6E8FEB86659FD93) + (ahead + 1).astype(np.uint64)
        met = met | _marked(ahead)
        if k > 1:
            yield _slot(h, c[at] + 2), _slot(h, met), met, met | own


_START = signs(START)
_MIX = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 63) for k in range(BEHIND + 1)], np.int64)


def _pairs(text: str) -> np.ndarray:
    c = np.concatenate([[2], classes(text)])
    return c[:-1] * CLASSES + c[1:]


def misread(text: str, wrong: str, right: str = "utf-8") -> str:
    """What a text looks like whose bytes by ``right`` were read by ``wrong``."""
    raw = text.encode(right)
    return "".join(_OPEN.get(b) or bytes([b]).decode("cp1252") for b in raw) if wrong == "cp1252" else raw.decode(wrong)


def _undone(text: str, wrong: str, right: str) -> str | None:
    try:
        raw = bytes([_SLOPPY[c] for c in text]) if wrong == "cp1252" else text.encode(wrong)
        return raw.decode(right)
    except (UnicodeError, KeyError):
        return None


class Model:
    """Log-probabilities of class bigrams, and of letters behind letters; ``counts``: of bigrams of signs; ``longer``: of stretches
    by slot."""

    def __init__(self, counts: np.ndarray, longer: np.ndarray | None = None):
        seen = counts.reshape(SIGNS, SIGNS)
        member = np.eye(CLASSES)[_CLASS_OF_SIGN]
        n = member.T @ seen @ member + 0.01
        self.cost = (-np.log(n / n.sum(1, keepdims=True)) + _SIZE[None]).ravel()
        # a letter as often as its class allows, and as it was seen behind the one before; of signs that are classes, any character
        own = np.concatenate([np.zeros(LETTERS), _SIZE])
        likely = np.exp(-self.cost.reshape(CLASSES, CLASSES)[_CLASS_OF_SIGN][:, _CLASS_OF_SIGN] + own[None])
        self.letters = (-np.log((seen + PRIOR * likely) / (seen.sum(1, keepdims=True) + PRIOR)) + own[None]).ravel()
        self.longer, self.members = longer, np.exp(own)
        p = np.exp(-self.letters.reshape(SIGNS, SIGNS))
        # how likely any marked letter is behind a sign, a sign behind any marked letter, and what the choice among such letters costs
        often = seen[:, 128:LETTERS].sum(0) + 1 / (LETTERS - 128)
        often = often / often.sum()
        choice = np.exp((often * np.log(often)).sum())
        self.marked = p[:, 128:LETTERS].sum(1)
        self.behind = often @ p[128:LETTERS]
        self.some = np.append(self.marked, self.behind[128:LETTERS].sum()) * choice

    def by_letters(self, text: str) -> float:
        c = np.concatenate([_START, signs(text)])
        cost = float(self.letters[c[BEHIND - 1 : -1] * SIGNS + c[BEHIND:]].sum())
        if self.longer is None or text.isascii():
            return cost
        at = _near(c, np.arange(BEHIND, len(c)))
        last, now = c[at - 1], c[at]
        own, after = _marked(now), _marked(last)
        first = p = np.exp(-self.letters[last * SIGNS + now])
        # a marked letter is likely by the sign ahead and, among its like, by all that is ahead
        whole = np.where(own & ~after, self.marked[last], 1.0)
        p = p / whole
        for both, ahead, met, counts in _stretches(c, at):
            p, whole = np.where(met, p * whole, p), np.where(met, 1.0, whole)
            total = self.longer[ahead]
            p = np.where(counts, (np.minimum(self.longer[both], total) / self.members[now] + TRUST * p) / (total + TRUST), p)
        # a stretch that comes again says nothing new: any marked letter would come again
        again = np.ones(len(at), bool)
        again[np.unique(np.lib.stride_tricks.sliding_window_view(c, BEHIND + 1)[at - BEHIND] @ _MIX, return_index=True)[1]] = False
        any_marked = np.where(own, self.some[np.where(after, SIGNS, last)], np.where(after, self.behind[now], first))
        return cost + float(np.log(first / np.where(again, any_marked, p * whole)).sum())

    def of(self, text: str) -> float:
        return float(self.cost[_pairs(text)].sum())

    def repaired(self, text: str | None) -> str | None:
        if text is None or text.isascii():
            return text
        first = self.of(text)
        best, heap, seen = (first, text), [(first, 0, text)], {text}
        while heap and len(seen) < LOOKED_AT:
            _, depth, now = heapq.heappop(heap)
            if depth == DEPTH or now.isascii():
                continue
            for wrong, right in STEPS:
                other = _undone(now, wrong, right)
                if other is not None and other not in seen:
                    seen.add(other)
                    cost = self.of(other)
                    heapq.heappush(heap, (cost, depth + 1, other))
                    best = min(best, (cost, other))
        return best[1] if best[0] < first - MARGIN else text


def fit(docs: DataFrame, text: str = "text", longer: bool = True) -> Model:
    """Bigrams of signs over all texts, a table a task; ``longer``: also the stretches around letters beyond ASCII, which bytes of
    unknown encoding need."""

    def run(batches):
        n = np.zeros(SIGNS * SIGNS + SLOTS * longer, np.int64)
        for b in batches:
            for (part,) in cut([b.column(0)]):
                texts = [t or "" for t in part.to_pylist()]
                every = signs("".join(START + t for t in texts))
                # a text begins behind signs that are not its own
                ahead = np.cumsum([0, *(BEHIND + len(t) for t in texts[:-1])])
                inside = np.ones(len(every), bool)
                inside[(ahead[:, None] + np.arange(BEHIND)).ravel()] = False
                at = np.flatnonzero(inside)
                n[: SIGNS * SIGNS] += np.bincount(every[at - 1] * SIGNS + every[at], minlength=SIGNS * SIGNS)
                if longer:
                    for both, before, _, counts in _stretches(every, _near(every, at)):
                        for slots in (both, before):
                            some, times = np.unique(slots[counts], return_counts=True)
                            n[SIGNS * SIGNS + some] += times
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["pair", "n"])

    out = np.zeros(SIGNS * SIGNS + SLOTS * longer)
    told = docs.select(F.col(text).cast("string")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out[told["pair"].to_numpy()] = told["n"].to_numpy()
    return Model(out[: SIGNS * SIGNS], out[SIGNS * SIGNS :].astype(np.float32) if longer else None)


def repaired(x: Column, model: Model) -> Column:
    return sliced(lambda s: [model.repaired(t) for t in s], "string")(x)


# bytes of unknown encoding ----------------------------------------------------------------------------------------------------

#: Encodings that are tried, in the order that decides between equal texts.
ENCODINGS = ("utf-8", "cp949", "cp1252", "euc_jp", "shift_jis", "gb18030", "utf-16-le", "utf-16-be", "mac_roman", "cp437", "cp1251", "koi8-r")
#: Nats for each byte beyond which no encoding is believed.
REJECTED = 6.0


def read(raw: bytes | None, model: Model) -> tuple[str | None, str | None, float]:
    """(encoding, text, posterior) of bytes: each encoding in which they are a text makes one, and the likeliest under the model is
    taken, letter by letter; the posterior is against the others that make another text. No encoding where none makes a likely text."""
    if raw is None:
        return None, None, 0.0
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return name, raw[len(mark) :].decode(name, "ignore"), 1.0
    found: dict[str, tuple[float, str]] = {}
    for name in ENCODINGS:
        try:
            text = raw.decode(name)
        except UnicodeDecodeError:
            continue
        found.setdefault(text, (model.by_letters(text), name))
    if not found:
        return None, None, 0.0
    text, (cost, name) = min(found.items(), key=lambda x: x[1][0])
    if raw and model.of(text) / len(raw) > REJECTED:
        return None, None, 0.0
    return name, text, float(1 / np.exp(np.minimum(0.0, cost - np.array([c for c, _ in found.values()]))).sum())


def decoded(content: Column, model: Model) -> Column:
    """(encoding, text, posterior) of a column of bytes."""
    fields = ("encoding", "text", "posterior")
    return sliced(lambda s: [dict(zip(fields, read(x, model), strict=True)) for x in s], "struct<encoding:string,text:string,posterior:double>")(content)
