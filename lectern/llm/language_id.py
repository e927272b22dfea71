"""Language identification by Bayesian fusion of evidence.

For each row the evidence for a language l is
    log P(text | l)       character trigrams, multinomial, trained on up to ``TRAIN_ROWS`` rows of each label
  + log P(declared | l)   the language that the markup (or a column) declares, right in ``1 - DECLARED_ERROR`` of cases
  + log P(suffix | l)     what the address's top-level domain suggests, right in ``1 - SUFFIX_ERROR`` of cases
  + log prior(l | host)   shares of the languages on the host, smoothed by those of its domain, which are smoothed by those
                          of all rows; grouped aggregations over all rows, the row's own vote taken out
and the posterior is normalised over all languages that occur as labels and ``und`` (none of them: trigrams as likely as any).

Trigrams depend on each other, so a text counts as at most ``EFFECTIVE`` of them; its mean over the whole text is used. A
row is kept if the known languages together have a posterior of ``MIN_KNOWN`` or more: one that mixes two of them stays.

A declaration must not be the label that the model is trained on: then it would be evidence for itself. So labelled rows are
judged without it, and what is declared counts for rows that are no part of the training, such as pages.

Null or empty texts bring no evidence of their own; null or unknown declarations and suffixes bring none either. Very long
texts are read whole, a part at a time. Tied posteriors go to the first language by name. Rows with a null address share the
empty host. Votes are integers, so results do not depend on the order of rows. Host counts are
aggregated before they are shuffled. Where all host rows together are at most ``BROADCAST_HOSTS`` they are broadcast;
beyond that rows are joined by host, an uneven join that Spark splits. Extra columns are ignored by ``identify`` and kept
by ``keep_known``. Repeated rows are judged one by one. Empty tables give empty results; without labelled rows every row
is ``und``.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.staging import filter_here, materialize, table, without
from lectern.llm.tokens import small_batches

TRAIN_ROWS, BINS, ALPHA = 4000, 1 << 16, 0.05
EFFECTIVE, DECLARED_ERROR, SUFFIX_ERROR, SMOOTHING, MIN_KNOWN = 60, 0.1, 0.2, 5.0, 0.6
BROADCAST_HOSTS = 20_000

#: Languages that top-level domains suggest.
SUFFIX_LANGUAGE = {
    "ar": "es", "at": "de", "au": "en", "br": "pt", "cl": "es", "cn": "zh", "co": "es", "cz": "cs", "de": "de", "dk": "da", "es": "es", "fi": "fi",
    "fr": "fr", "gr": "el", "hu": "hu", "ie": "en", "it": "it", "jp": "ja", "kr": "ko", "li": "de", "mx": "es", "nl": "nl", "no": "no", "nz": "en",
    "pe": "es", "pl": "pl", "pt": "pt", "ro": "ro", "ru": "ru", "se": "sv", "tr": "tr", "ua": "uk", "uk": "en", "us": "en", "ve": "es",
}

_MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def plain(page: str) -> str:
    return _html.unescape(_MARKUP.sub(" ", page))


def trigrams(text: str) -> np.ndarray:
    """Bins of the trigrams of the whole text: lower-case letters, one blank for whatever stands between words."""
    c = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    letter = ((c >= 97) & (c <= 122)) | ((c >= 0xC0) & (c != 0xD7) & (c != 0xF7))
    c = np.where(letter, c, 32)
    c = c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))]
    if len(c) < 3 or not letter.any():
        return np.zeros(0, np.uint32)
    h = (c[:-2] * np.uint32(0x9E3779B1) + c[1:-1]) * np.uint32(0x85EBCA77) + c[2:]
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE3D)) >> np.uint32(16)


@dataclass(frozen=True)
class Model:
    """``weights[bin, k]``: log P(bin | names[k]); the last name is ``und``."""

    names: tuple[str, ...]
    weights: np.ndarray

    def text(self, text: str | None) -> np.ndarray:
        t = trigrams(text or "")
        if not len(t):
            return np.zeros(len(self.names))
        total = np.zeros(len(self.names))
        for k in range(0, len(t), 1 << 18):
            total += self.weights[t[k : k + (1 << 18)]].sum(0, dtype=np.float64)
        return total / len(t) * min(len(t), EFFECTIVE)

    def hint(self, language: str | None, error: float) -> np.ndarray:
        n = len(self.names) - 1
        if not language or not n:
            return np.zeros(n + 1)
        known = np.array([x == language for x in self.names[:-1]])
        right = np.where(known, 1 - error, error / max(1, n - int(known.any())) if known.any() else error)
        return np.log(np.append(right, 1 / (n + 1)))


def _sample(known: DataFrame, rows: int) -> DataFrame:
    """(label, text): for each label the ``rows`` rows with the smallest ``h``, all if it has no more. Rows with the same h are
    the same. Rows are counted by label and leading bits of h, further bits where those leave too many."""
    spark = known.sparkSession
    cuts: dict[str, int] = {}
    left: dict[str, tuple[int, int, int]] = {}  # label: first and last h that are in question, rows that are needed of these
    shift, asked = 54, known
    while True:
        counts: dict[str, list] = {}
        for label, b, n in asked.groupBy("label", F.shiftright("h", shift).alias("b")).agg(F.count("*")).collect():
            counts.setdefault(label, []).append((b, n))
        for label, found in counts.items():
            need = left.pop(label, (0, 0, rows))[2]
            cuts[label] = (1 << 63) - 1 if label not in cuts else cuts[label]
            for b, n in sorted(found):
                if n >= need:
                    cuts[label] = ((b + 1) << shift) - 1
                    if n > need + rows and shift > 4:
                        left[label] = (b << shift, cuts[label], need)
                    break
                need -= n
        if not left:
            break
        shift -= 10
        asked = known.join(F.broadcast(spark.createDataFrame([(k, *v[:2]) for k, v in left.items()], "label string, low long, high long")), "label").filter("h between low and high")
    limits = lambda x: F.broadcast(spark.createDataFrame(list(x.items()), "label string, cut long"))
    near = materialize(known.join(limits(cuts), "label").filter("h <= cut").groupBy("label", "h").agg(F.first("text").alias("text")), "sample")
    held: dict[str, list] = {}
    for label, h in near.select("label", "h").collect():
        held.setdefault(label, []).append(h)
    last = {k: sorted(v)[min(rows, len(v)) - 1] for k, v in held.items()}
    return near.join(limits(last), "label").filter("h <= cut").select("label", "text")


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Train on at most ``rows`` labelled rows for each label, those with the smallest hashes of id and text. So every label
    that occurs is a class, however few rows have it."""
    label, text = F.lower(F.col(f"`{label_col}`").cast("string")), F.col(f"`{text_col}`")
    known = labelled.select(label.alias("label"), text.alias("text"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("h")).filter("label is not null and text is not null")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in small_batches(batches):
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums.setdefault(label, np.zeros(BINS, np.int64))
                sums[label] += np.bincount(trigrams(text), minlength=BINS)
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[x].tobytes() for x in names], pa.binary())], names=["label", "n"])

    got: dict[str, np.ndarray] = {}
    for r in _sample(known, rows).coalesce(8).mapInArrow(count, "label string, n binary").collect():
        got[r["label"]] = got.get(r["label"], 0) + np.frombuffer(r["n"], np.int64)
    names = sorted(got)
    columns = [np.log((got[x] + ALPHA) / (got[x].sum() + ALPHA * BINS)) for x in names]
    return Model((*names, "und"), np.column_stack([*columns, np.full(BINS, -np.log(BINS))]).astype(np.float32))


def _host(url: str | None) -> str:
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else (url or "") if "/" not in (url or "/") else ""


def _scorer(model: Model, markup: bool):
    def run(batches):
        for b in small_batches(batches):
            out = []
            for declared, address, text in zip(b.column("declared").to_pylist(), b.column("address").to_pylist(), b.column("text").to_pylist(), strict=True):
                host = _host(address)
                if markup:
                    m = re.search(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", text or "", re.I)
                    declared = m[1] if m else declared
                    text = plain(text or "")
                declared = re.split("[-_]", declared.strip().lower())[0] if declared else None
                labels = host.split(".")
                suffix = SUFFIX_LANGUAGE.get(labels[-1]) if len(labels) > 1 else None
                said = model.text(text)
                evidence = said + model.hint(declared, DECLARED_ERROR) + model.hint(suffix, SUFFIX_ERROR)
                out.append((host, ".".join(labels[-2:]), declared, suffix, model.names[int(said.argmax())] if said.any() else None, int(evidence.argmax()), evidence))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.string()] * 5 + [pa.int32(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["id", "key", "host", "domain", "declared", "suffix", "text_lang", "vote", "evidence"])

    return run


def _tallies(scored: DataFrame, by: list[str], classes: int, name: str) -> DataFrame:
    """For each group the number of votes for each class."""
    n = scored.groupBy(*by, "vote").agg(F.count("*").alias("n")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("vote", "n"))).alias("m"))
    votes = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double"))
    return n.select(*by, votes.alias(name))


def _judge(rows: DataFrame, model: Model, markup: bool) -> DataFrame:
    """``rows``: id, key, declared, address, text."""
    classes = len(model.names)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, key string, host string, domain string, declared string, suffix string, text_lang string, vote int, evidence array<double>"
    scored = materialize(rows.mapInArrow(_scorer(model, markup), schema), "evidence")
    every = [0] * classes
    for r in scored.groupBy("vote").agg(F.count("*").alias("n")).collect():
        every[r["vote"]] = r["n"]
    base = [(x + 1) / (sum(every) + classes) for x in every]
    hosts = materialize(_tallies(scored, ["host", "domain"], classes, "on_host").join(_tallies(scored, ["domain"], classes, "on_domain"), "domain").drop("domain"), "hosts")
    few = hosts.count() <= BROADCAST_HOSTS
    met = scored.join(F.broadcast(hosts) if few else hosts, "host")
    without = lambda c: F.transform(c, lambda n, i: n - (i == F.col("vote")).cast("double"))  # noqa: E731  the row's own vote says nothing new
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    met = met.withColumn("on_host", without("on_host")).withColumn("on_domain", without("on_domain"))
    met = met.withColumn("all_host", total("on_host")).withColumn("all_domain", total("on_domain"))
    g = F.array(*[F.lit(float(x)) for x in base])
    domain = F.zip_with("on_domain", g, lambda n, p: (n + SMOOTHING * p) / (F.col("all_domain") + SMOOTHING))
    met = met.withColumn("domain_share", domain)
    prior = F.zip_with("on_host", "domain_share", lambda n, p: (n + SMOOTHING * p) / (F.col("all_host") + SMOOTHING))
    met = met.withColumn("logs", F.zip_with("evidence", prior, lambda e, p: e + F.ln(p)))
    met = met.withColumn("top", F.array_max("logs"))
    met = met.withColumn("scale", F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    names = F.array(*[F.lit(x) for x in model.names])
    met = met.withColumn("language", F.element_at(names, F.array_position("logs", F.col("top")).cast("int"))).withColumn("posterior", F.round(1 / F.col("scale"), 6))
    unknown = F.exp(F.element_at("logs", -1) - F.col("top")) / F.col("scale")
    return met.withColumn("kept", 1 - unknown >= MIN_KNOWN).select("id", "key", "host", "declared", "suffix", "text_lang", "language", "posterior", "kept")


def _column(df: DataFrame, name: str | None) -> Column:
    return F.col(f"`{name}`").cast("string") if name else F.lit(None).cast("string")


def identify(df: DataFrame, model: Model, id_col: str, text_col: str, address_col: str | None = None, declared_col: str | None = None, markup: bool = False) -> DataFrame:
    """Per row: id, host, declared, suffix, text_lang, language, posterior, kept."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.lit("").alias("key"), _column(df, declared_col).alias("declared"), _column(df, address_col).alias("address"), _column(df, text_col).alias("text"))
    return _judge(rows, model, markup).drop("key").withColumnRenamed("id", id_col)


def keep_known(df: DataFrame, model: Model, text_col: str = "text", address_col: str | None = None, declared_col: str | None = None) -> DataFrame:
    """The rows that are kept, with the input's columns. What is judged is (text, declaration, address), so the rows that go
    are found again by a digest of these."""
    parts = [F.coalesce(_column(df, c), F.lit("\x00")) for c in (text_col, address_col, declared_col)]
    key = F.md5(F.concat_ws("\x01", *parts))
    rows = df.select(F.lit(0).alias("id"), key.alias("key"), _column(df, declared_col).alias("declared"), _column(df, address_col).alias("address"), _column(df, text_col).alias("text"))
    return without(df, key, filter_here(_judge(rows, model, False), ~F.col("kept")).select("key"))


# the query ------------------------------------------------------------------------------------------------------------


def op2_evidence_fusion(spark, sf_dir):
    """Documents, whose host is their source, and pages, with the language of their markup and address: one row each, with
    doc_id or page_id. The model is trained on the documents' labels, so these are no evidence here."""
    documents = table(spark, sf_dir, "documents")
    model = fit(documents)
    found = identify(documents, model, "doc_id", "text", "source")
    return found.unionByName(identify(table(spark, sf_dir, "pages"), model, "page_id", "html", "url", markup=True), allowMissingColumns=True)


QUERIES = {"op2_evidence_fusion": op2_evidence_fusion}
SQL: dict[str, str] = {}
