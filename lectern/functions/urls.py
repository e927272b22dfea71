"""URL, key and date functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the name space of URLs for version 5 UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def host(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url) -> Column:
    return F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url) -> Column:
    return F.regexp_extract(_c(url), r"\?([^#]*)", 1)


def path_parts(url) -> Column:
    return F.filter(F.split(path(url), "/"), lambda p: p != "")


def section(url) -> Column:
    """The first two parts of the path."""
    return F.array_join(F.slice(path_parts(url), 1, 2), "/")


def param(url, name: str) -> Column:
    """The first value of a parameter; empty where there is none."""
    return F.regexp_extract(_c(url), r"[?&]" + name.replace(".", r"\.") + r"=([^&#]*)", 1)


def _rebuilt(url, pairs: Column) -> Column:
    base = F.regexp_extract(_c(url), r"^([^?#]*)", 1)
    return F.when(F.size(pairs) > 0, F.concat(base, F.lit("?"), F.array_join(pairs, "&"))).otherwise(base)


def normalize(url) -> Column:
    """No fragment, no page offset, parameters sorted."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~p.startswith("article.offset="))
    return _rebuilt(url, F.array_sort(pairs))


def clean(url) -> Column:
    """No fragment, offset, limit or blank parameters; order kept."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: p.rlike("=.") & ~p.rlike(r"^article(\.offset|Limit)="))
    return _rebuilt(url, pairs)


def doc_id(url) -> Column:
    """{first label of the host}_{slug}, with the article's number, or its offset, or the page, or a digest of the query."""
    site, parts = F.element_at(F.split(host(url), r"\."), 1), path_parts(url)
    slug = F.when(F.size(parts) > 0, F.regexp_replace(F.element_at(parts, -1), r"\.[A-Za-z]+$", "")).otherwise("index")
    base = F.concat_ws("_", site, slug)
    no, off, page = param(url, "articleNo"), param(url, "article.offset"), param(url, "page")
    return (
        F.when(no != "", F.concat_ws("_", base, no))
        .when(off != "", F.concat_ws("_", base, off))
        .when(page != "", F.concat(base, F.lit("_p"), page))
        .when(query(url) != "", F.concat_ws("_", base, F.left(F.md5(query(url)), F.lit(8))))
        .otherwise(base)
    )


def as_uuid(hex32: Column) -> Column:
    return F.regexp_replace(hex32, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def uuid_of(x) -> Column:
    """A UUID made of the MD5 of an id."""
    return as_uuid(F.md5(_c(x)))


def point_id(url, text) -> Column:
    return F.md5(F.concat(_c(url), F.lit("::"), F.left(_c(text), F.lit(100))))


def uuid5(url) -> Column:
    """The version 5 UUID of a URL."""
    h = F.left(F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(_c(url), "UTF-8"))), F.lit(32))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return as_uuid(F.concat(F.left(h, F.lit(12)), F.lit("5"), F.substring(h, 14, 3), F.right(variant, F.lit(1)), F.substring(h, 18, 15)))


def best_date(*texts) -> Column:
    """The first of the texts that is a date: dots are dashes, what follows a T is cut, nothing else may follow."""
    one = lambda x: F.try_to_date(F.regexp_replace(F.regexp_replace(F.btrim(_c(x)), r"\.", "-"), "T.*$", ""), "yyyy-M-d")
    return F.coalesce(*[one(x) for x in texts])


def joined(base, href) -> Column:
    """An address as seen from a page: whole ones stay; the rest by scheme, host, path or query of the base. Steps up and on the
    spot are taken out of the path; a fragment goes."""
    b, h = _c(base), F.regexp_replace(F.btrim(_c(href)), "#.*$", "")
    origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(path(b), r"^(.*/)", 1)
    where = F.regexp_extract(h, r"^([^?]*)", 1)
    rest = F.regexp_extract(h, r"(\?.*)$", 1)
    whole = F.when(where.startswith("/"), where).when(where == "", path(b)).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), where))
    steps = F.split(whole, "/")
    climbed = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda a, s: F.when(s == ".", a).when((s == "..") & (F.size(a) > 1), F.slice(a, F.lit(1), F.size(a) - 1)).when(s == "..", a).otherwise(F.concat(a, F.array(s))),
    )
    last = F.when(F.element_at(steps, -1).isin(".", ".."), F.lit("/")).otherwise("")
    asked = F.when((where == "") & (rest == ""), F.concat(F.lit("?"), query(b))).otherwise(rest)
    asked = F.when(asked == "?", F.lit("")).otherwise(asked)
    built = F.concat(origin, F.array_join(climbed, "/"), last, asked)
    return F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), h)).otherwise(built)


def resolve(base, href) -> Column:
    """A link's canonical address: joined with its page's, without fragment and page offset, parameters sorted."""
    return normalize(joined(base, href))


def site_code(url) -> Column:
    """The first label of an academic Korean host, or else the whole host."""
    h = F.regexp_replace(host(url), r":\d+$", "")
    return F.when(h.rlike(r"^[^.]+\..*ac\.kr$") & (F.size(F.split(h, r"\.")) >= 3), F.element_at(F.split(h, r"\."), 1)).otherwise(h)


def slug(url) -> Column:
    """The path with low lines, without endings of scripts; root if it is empty."""
    p = F.regexp_replace(path(url), "^/+|/+$", "")
    return F.when(p == "", F.lit("root")).otherwise(F.replace(F.replace(F.replace(p, F.lit("/"), F.lit("_")), F.lit(".do"), F.lit("")), F.lit(".jsp"), F.lit("")))


def page_key(url, kind) -> Column:
    """{site}_notice_{article number or slug} for posts, {site}_page_{slug} for pages."""
    no = param(url, "articleNo")
    return F.when(_c(kind) == "board_notice", F.concat(site_code(url), F.lit("_notice_"), F.when(no != "", no).otherwise(slug(url)))).otherwise(F.concat(site_code(url), F.lit("_page_"), slug(url)))


def fields(url, name) -> Column:
    """Domain, path, first section and key of an address; of the file's name where there is none."""
    word = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), r"(?U)\W+", "_"), "^_+|_+$", "")
    none = F.coalesce(_c(url), F.lit("")) == ""
    where = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    first = F.coalesce(F.get(path_parts(url), F.lit(0)), F.lit(""))
    key = F.when(none, word(F.regexp_replace(_c(name), r"\.[^.]*$", ""))).otherwise(word(F.concat(host(url), path(url))))
    return F.struct(F.when(none, "").otherwise(host(url)).alias("domain"), F.when(none, "").otherwise(where).alias("source_path"), F.when(none, "").otherwise(first).alias("section"), key.alias("doc_id"))


def today_in(zone: str, now=None) -> Column:
    """Today's date in a time zone; ``now`` (an instant) makes it repeatable."""
    return F.from_utc_timestamp(F.to_utc_timestamp(now if now is not None else F.current_timestamp(), F.current_timezone()), zone).cast("date")


def months_ago(day, months: int) -> Column:
    """The day so many months of thirty days before."""
    return F.date_sub(_c(day), 30 * months)
