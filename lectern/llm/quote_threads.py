"""Quotation linking: from messages that quote each other to reply-ordered conversations without quotes.

1. A line's quote level is the number of ``>`` that it begins with. A passage is a run of lines of one level without a blank
   line between them; it is normalised (markers off, lower case, white space collapsed) and hashed.
2. The original of a passage is the first message that says it at level 0: the first one of the same conversation, or else
   of all conversations; it must come before the quoting message in the order (conversation, turn).
3. A message's parent is the original of its first linked passage of the lowest level. Roots and depths of the replies are
   found by pointer doubling, whose rounds grow with the logarithm of the longest chain.
4. The result is ordered by (root, depth, conversation, turn): a message stands after what it answers, and what quotes
   nothing stands in the order of its turns. Bodies are the lines of level 0, without lines that announce a quote.

DataFrame functions only. Lines are taken apart within their row. Passages are aggregated by hash before anything is joined
with them, so a passage that a third of all messages hold is a row for each task; the join of quoted passages with
originals has one row a hash on one side, and Spark splits its uneven partitions. No conversation is gathered anywhere.

Texts of any length are taken apart whole, in their row. Null texts are empty messages; rows with a null conversation or
turn are kept and never linked; rows that share both are kept and get the same links. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.staging import materialize, table

#: The quote marker, and lines that announce a quote.
MARK = "^((?:[ \\t]*>)+)"
ANNOUNCES = "^[ \\t]*(On|Le|Am|El)[ ,].*(wrote|écrit|schrieb|escribió)[ \\t]*:[ \\t]*$"


def parsed(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, body, passages (k, level, hash)."""
    df = messages.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n").alias("raw"))
    level = lambda x: F.length(F.translate(F.regexp_extract(x, MARK, 1), " \t", ""))
    line = lambda x: F.struct(level(x).alias("level"), F.btrim(F.regexp_replace(x, MARK, ""), F.lit(" \t\r")).alias("body"), x.alias("raw"))
    df = df.select("conv", "turn", "role", F.transform("raw", line).alias("lines"))
    first = lambda i: (F.get("lines", i)["body"] != "") & ((i == 0) | (F.get("lines", i - 1)["body"] == "") | (F.get("lines", i - 1)["level"] != F.get("lines", i)["level"]))
    df = df.select("*", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), first).alias("starts"))
    said = lambda b, k: F.transform(F.slice("lines", b + 1, F.coalesce(F.get("starts", k + 1), F.size("lines")) - b), lambda x: x["body"])
    norm = lambda b, k: F.btrim(F.regexp_replace(F.lower(F.array_join(said(b, k), " ")), "[ \\t\\r]+", " "))
    passage = F.transform("starts", lambda b, k: F.struct(k.alias("k"), F.get("lines", b)["level"].alias("level"), F.md5(norm(b, k)).alias("hash")))
    own = F.filter("lines", lambda x, i: (x["level"] == 0) & ~(x["raw"].rlike(ANNOUNCES) & (F.coalesce(F.get("lines", i + 1)["level"], F.lit(0)) > 0)))
    return df.select("conv", "turn", "role", F.btrim(F.array_join(F.transform(own, lambda x: x["raw"]), "\n"), F.lit(" \t\r\n")).alias("body"), passage.alias("passages"))


def parents(messages: DataFrame) -> DataFrame:
    """conv, turn, parent_conv, parent_turn, n_linked of the messages of which a passage was linked. Lines are taken apart
    once; what follows reads hashes."""
    rows = messages.select("conv", "turn", F.explode_outer("passages").alias("p")).select("conv", "turn", "p.*")
    rows = materialize(rows, "passages").filter("conv is not null and turn is not null and hash is not null")
    quoted = rows.filter("level > 0")
    here = rows.filter("level = 0").groupBy("hash", "conv").agg(F.min("turn").alias("turn0"))
    anywhere = here.groupBy("hash").agg(F.min(F.struct("conv", "turn0")).alias("first"))
    met = quoted.join(here, ["hash", "conv"], "left").join(anywhere, "hash", "left")
    same = F.col("turn0") < F.col("turn")
    before = (F.col("first.conv") < F.col("conv")) | ((F.col("first.conv") == F.col("conv")) & (F.col("first.turn0") < F.col("turn")))
    origin = F.when(same, F.struct(F.col("conv").alias("pc"), F.col("turn0").alias("pt"))).when(before, F.struct(F.col("first.conv").alias("pc"), F.col("first.turn0").alias("pt")))
    met = met.select("conv", "turn", "level", "k", origin.alias("o")).filter("o is not null").distinct()
    best = met.groupBy("conv", "turn").agg(F.min(F.struct("level", "k", "o")).alias("b"), F.count("*").alias("n_linked"))
    return best.select("conv", "turn", F.col("b.o.pc").alias("parent_conv"), F.col("b.o.pt").alias("parent_turn"), "n_linked")


def roots(linked: DataFrame) -> DataFrame:
    """conv, turn, root_conv, root_turn, reply_depth by pointer doubling over the linked messages."""
    now = materialize(linked.select("conv", "turn", F.col("parent_conv").alias("root_conv"), F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("reply_depth")), "replies")
    while True:
        up = now.select(F.col("conv").alias("root_conv"), F.col("turn").alias("root_turn"), F.col("root_conv").alias("up_conv"), F.col("root_turn").alias("up_turn"), F.col("reply_depth").alias("more"))
        if not now.join(up, ["root_conv", "root_turn"], "left_semi").limit(1).count():
            return now
        met = now.join(up, ["root_conv", "root_turn"], "left")
        higher = F.col("up_conv").isNotNull()
        met = met.select("conv", "turn", F.when(higher, F.col("up_conv")).otherwise(F.col("root_conv")).alias("root_conv"), F.when(higher, F.col("up_turn")).otherwise(F.col("root_turn")).alias("root_turn"), (F.col("reply_depth") + F.coalesce("more", F.lit(0))).alias("reply_depth"))
        now = materialize(met, "replies")


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per message, in reply order: its keys, role, body, n_quoted, max_level, n_linked, parent, root and reply_depth."""
    rows = parsed(messages, conv_col, turn_col, role_col, text_col)
    linked = materialize(parents(rows), "parents")
    found = linked.join(roots(linked), ["conv", "turn"])
    quoted = F.filter("passages", lambda p: p["level"] > 0)
    narrow = rows.select("conv", "turn", "role", "body", F.size(quoted).cast("long").alias("n_quoted"), F.coalesce(F.array_max(F.transform(quoted, lambda p: p["level"])), F.lit(0)).cast("long").alias("max_level"))
    out = narrow.join(found, ["conv", "turn"], "left").select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "body", "n_quoted", "max_level",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent_conv", "parent_turn",
        F.coalesce("root_conv", "conv").alias("root_conv"), F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("reply_depth", F.lit(0)).cast("long").alias("reply_depth"),
    )
    return out.orderBy("root_conv", "root_turn", "reply_depth", conv_col, turn_col)


# the query ------------------------------------------------------------------------------------------------------------


def op1_quote_threads(spark, sf_dir):
    return conversations(table(spark, sf_dir, "conversations"))


QUERIES = {"op1_quote_threads": op1_quote_threads}
SQL = {
    "op1_quote_threads": r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id AS conv, turn, role, string_split(coalesce(text, ''), chr(10)) AS raw FROM conversations),
l AS (SELECT r, conv, turn, i, raw[i] AS raw, length(translate(regexp_extract(raw[i], '^((?:[ \t]*>)+)', 1), ' ' || chr(9), '')) AS level,
             trim(regexp_replace(raw[i], '^((?:[ \t]*>)+)', ''), ' ' || chr(9) || chr(13)) AS body FROM m, unnest(range(1, len(raw) + 1)) AS u(i)),
s AS (SELECT *, CASE WHEN body <> '' AND (i = 1 OR lag(body) OVER w = '' OR lag(level) OVER w <> level) THEN 1 ELSE 0 END AS starts,
             coalesce(lead(level) OVER w, 0) AS next_level FROM l WINDOW w AS (PARTITION BY r ORDER BY i)),
g AS (SELECT *, sum(starts) OVER (PARTITION BY r ORDER BY i) AS k FROM s),
p AS (SELECT r, any_value(conv) AS conv, any_value(turn) AS turn, k, max(level) AS level,
             md5(trim(regexp_replace(lower(string_agg(body, ' ' ORDER BY i)), '[ \t\r]+', ' ', 'g'))) AS hash FROM g WHERE body <> '' GROUP BY r, k),
here AS (SELECT hash, conv, min(turn) AS turn0 FROM p WHERE level = 0 AND conv IS NOT NULL AND turn IS NOT NULL GROUP BY hash, conv),
anywhere AS (SELECT hash, min({'c': conv, 't': turn0}) AS f FROM here GROUP BY hash),
q AS (SELECT DISTINCT p.conv, p.turn, p.level, p.k, CASE WHEN here.turn0 < p.turn THEN p.conv ELSE f.c END AS pc, CASE WHEN here.turn0 < p.turn THEN here.turn0 ELSE f.t END AS pt
      FROM p LEFT JOIN here ON here.hash = p.hash AND here.conv = p.conv LEFT JOIN anywhere ON anywhere.hash = p.hash
      WHERE p.level > 0 AND (here.turn0 < p.turn OR f.c < p.conv OR (f.c = p.conv AND f.t < p.turn))),
best AS (SELECT conv, turn, arg_min(pc, {'l': level, 'k': k}) AS pc, arg_min(pt, {'l': level, 'k': k}) AS pt, count(*) AS n_linked FROM q GROUP BY conv, turn),
up AS (SELECT conv, turn, pc, pt, 1 AS d FROM best UNION ALL SELECT up.conv, up.turn, b.pc, b.pt, d + 1 FROM up JOIN best b ON b.conv = up.pc AND b.turn = up.pt),
top AS (SELECT conv, turn, arg_max(pc, d) AS root_conv, arg_max(pt, d) AS root_turn, max(d) AS d FROM up GROUP BY conv, turn),
b AS (SELECT r, trim(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (level = 0 AND NOT (next_level > 0 AND regexp_matches(raw, '^[ \t]*(On|Le|Am|El)[ ,].*(wrote|écrit|schrieb|escribió)[ \t]*:[ \t]*$'))), ''), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM g GROUP BY r),
n AS (SELECT r, count(*) AS n_quoted, max(level) AS max_level FROM p WHERE level > 0 GROUP BY r)
SELECT m.conv AS conv_id, m.turn, m.role, b.body, coalesce(n.n_quoted, 0)::BIGINT AS n_quoted, coalesce(n.max_level, 0)::BIGINT AS max_level, coalesce(best.n_linked, 0)::BIGINT AS n_linked,
       best.pc AS parent_conv, best.pt AS parent_turn, coalesce(top.root_conv, m.conv) AS root_conv, coalesce(top.root_turn, m.turn) AS root_turn, coalesce(top.d, 0)::BIGINT AS reply_depth
FROM m JOIN b ON b.r = m.r LEFT JOIN n ON n.r = m.r LEFT JOIN best ON best.conv = m.conv AND best.turn = m.turn LEFT JOIN top ON top.conv = m.conv AND top.turn = m.turn"""
}
