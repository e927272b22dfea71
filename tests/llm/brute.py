"""Plain Python versions of operators that SQL cannot express: loops over whole tables."""

import collections
import math
import re

import numpy as np

from lectern.llm import decontaminate, language_id, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(t):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = collections.Counter(grams)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len({k for i, g in enumerate(grams) if n[g] > 1 for k in range(i, i + 8)})


def good(t):
    """Whether a text passes the quality rules, by the table of thresholds."""
    n, chars, symbols, dups, repeats = counts(t)
    if n < 20 or 100 * repeats > 30 * n:
        return False
    t = t or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    stops = {s for x in quality_rules.STOP_WORDS for s in (x, x.capitalize())}
    m = {
        "n_words": n, "mean_word_chars": chars / n, "symbol_ratio": symbols / n, "stop_ratio": sum(x.translate(dict.fromkeys(map(ord, ".,;:"))) in stops for x in w) / n,
        "run_ratio": sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, "dup_line_ratio": dups / max(1, len(lines)),
        "bullet_line_ratio": sum(x.lstrip(" ")[:1] in tuple("-*•·") and x.strip(" ") != "" for x in lines) / max(1, len(lines)), "ellipsis_line_ratio": sum(x.rstrip(" ").endswith(("...", "…")) for x in lines) / max(1, len(lines)),
    }
    return all((r.low is None or m[r.metric] >= r.low) and (r.high is None or m[r.metric] <= r.high) for r in quality_rules.RULES)


def posteriors(train, rows):
    """[(language, posterior, kept)] of rows (text, declared, host, domain, suffix language), trained on (label, text)."""
    by = collections.defaultdict(collections.Counter)
    for label, text in train:
        by[label.lower()].update(language_id.trigrams(text).tolist())
    names = sorted(by)
    bins, alpha = language_id.BINS, language_id.ALPHA
    total = {x: sum(by[x].values()) for x in names}
    evidence = []
    for text, declared, _, _, suffix in rows:
        t = language_id.trigrams(text or "").tolist()
        e = []
        for x in (*names, "und"):
            log = sum(math.log(1 / bins) if x == "und" else math.log((by[x][g] + alpha) / (total[x] + alpha * bins)) for g in t)
            v = log / len(t) * min(len(t), language_id.EFFECTIVE) if t else 0.0
            for hint, error in ((declared, language_id.DECLARED_ERROR), (suffix, language_id.SUFFIX_ERROR)):
                if hint and names:
                    known = hint in names
                    p = 1 / (len(names) + 1) if x == "und" else 1 - error if x == hint else error / max(1, len(names) - 1) if known else error
                    v += math.log(p)
            e.append(v)
        evidence.append(e)
    k = len(names) + 1
    votes = [int(np.argmax(e)) for e in evidence]
    every = [(votes.count(x) + 1) / (len(rows) + k) for x in range(k)]
    out = []
    for i, (_, _, host, domain, _) in enumerate(rows):
        near = [votes[j] for j, r in enumerate(rows) if j != i and r[2:4] == (host, domain)]
        wide = [votes[j] for j, r in enumerate(rows) if j != i and r[3] == domain]
        s = language_id.SMOOTHING
        share = [(wide.count(x) + s * every[x]) / (len(wide) + s) for x in range(k)]
        prior = [(near.count(x) + s * share[x]) / (len(near) + s) for x in range(k)]
        logs = [a + math.log(b) for a, b in zip(evidence[i], prior, strict=True)]
        p = np.exp(np.array(logs) - max(logs))
        p /= p.sum()
        out.append(((*names, "und")[int(np.argmax(logs))], float(p.max()), bool(1 - p[-1] >= language_id.MIN_KNOWN)))
    return out


def groups(ids, texts, least=0.8, words=5):
    """For each row the smallest id that is not null of those whose sets of shingles are linked with its own."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([b" ".join(w)] if w else []))
    parent = list(range(len(ids)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) >= least * len(a | b)):
                parent[top(i)] = top(j)
    first = {}
    for i, d in enumerate(ids):
        if d is not None:
            first[top(i)] = min(first.get(top(i), d), d)
    return [first.get(top(i)) for i in range(len(ids))]


def local(a, b, mismatch, gap):
    """Smith-Waterman, cell by cell."""
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else mismatch), h[i - 1][j] - gap, h[i][j - 1] - gap)
            best = max(best, h[i][j])
    return best


def copies(text, item):
    """The score of an item that a text copies, or None: by alignment of all of both."""
    a, b = decontaminate.words(item), decontaminate.words(text)
    if not {tuple(a[i : i + 3]) for i in range(len(a) - 2)} & {tuple(b[i : i + 3]) for i in range(len(b) - 2)}:
        return None
    score = local(a, b, -1, 1)
    share = score / (2 * len(a))
    return share if share >= decontaminate.THRESHOLD or local(a, b, -decontaminate.EDIT, decontaminate.EDIT) >= 2 * decontaminate.PASSAGE else None
