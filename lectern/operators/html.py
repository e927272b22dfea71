"""HTML operators: one parse of a page, and whatever parts are asked for of it, as one struct column.

    pages.withColumn("p", html.parts("html", "url", ("content", "board")))

A page is parsed once, however many parts are asked for, in Arrow batches; everything behind it is native. A null page is an
empty one; parts that a page lacks are null or empty.
"""

from __future__ import annotations

import hashlib
import mimetypes
import os
import re
from urllib.parse import unquote, urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import dom
from lectern.functions.dom import Node, has_class, inside, named
from lectern.functions.slices import sliced
from lectern.functions.text import EMAIL, EMAIL_MARK, TABLE_MARKS
from lectern.operators.pages import ICONS

#: Elements without text of their own, parts of names that are no content, and parts of names that are.
NO_CONTENT = frozenset("script style noscript iframe nav header footer aside form button input select textarea".split())
NO_CONTENT_NAMES = (
    "nav sidebar header footer breadcrumb share social comment ad advertisement banner popup login search pagination paging related recommend popular recent copyright privacy terms "
    "gnb lnb snb top-menu bottom-menu side-menu util-menu quick-menu floating footer-wrapper"
).split()
CONTENT_NAMES = "content article main body post entry text detail board notice view".split()
MAIN_ID = "jwxe_main_content"
QUALITY_DROPS = frozenset("script style nav header footer".split())
OLD_DROPS = frozenset("script style noscript header footer nav aside".split())
OLD_ROLES = frozenset("banner navigation contentinfo".split())
#: Labels of a post's head, the caption of menu tables, download marks and endings, image endings.
AUTHOR, VIEWS, POSTED = "작성자", "조회", "작성일"
MENU_CAPTION = "식당 메뉴 표"
DOWNLOAD_ENDS = (".pdf", ".hwp", ".docx", ".xlsx", ".zip")
NO_DOWNLOAD = ("/cms/fileDownload.do",)
IMAGE_ENDS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".svg")
EDITOR_IMAGE = "editorimage.do"

_DATE = re.compile(r"(\d{4})[.-](\d{2})[.-](\d{2})")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_NO_CONTENT = re.compile("|".join(NO_CONTENT_NAMES), re.I)
_NUMBER = re.compile(r"(?:[?&])articleNo=(\d+)", re.I)


def _date(text: str | None) -> str | None:
    m = _DATE.search(text or "")
    return "-".join(m.groups()) if m else None


def _flat(n: Node | None) -> str:
    return " ".join(n.text(" ").split()) if n is not None else ""


def _has(n: Node, key: str) -> bool:
    return key in n.attrs


def _strip(root: Node, gone) -> None:
    for n in root.all(where=gone):
        n.drop()


# content, summaries, snapshots --------------------------------------------------------------------------------------------


def find_main(root: Node) -> Node:
    """The element that holds the page's text: by the content system's id (the longest; a ``main`` counts 1000 less), ``main``,
    ``article``, its role, the longest division with a name of content, or else the body."""
    marked = root.all(where=lambda n: n.attrs.get("id") == MAIN_ID)
    sizes = root.lengths()
    if marked:
        return max(marked, key=lambda n: sizes[id(n)] - 1000 * (n.tag == "main"))
    for test in (lambda: root.first("main"), lambda: root.first("article"), lambda: root.first(where=lambda n: n.attrs.get("role") == "main")):
        if (n := test()) is not None:
            return n
    # of equally long ones that of the first name
    tests = [named(name, (key,)) for name in CONTENT_NAMES for key in ("class", "id")]
    found = []
    for n in root.all("div", "section", where=lambda n: "class" in n.attrs or "id" in n.attrs):
        first = next((k for k, test in enumerate(tests) if test(n)), None)
        if first is not None:
            found.append((-sizes[id(n)], first, len(found), n))
    return min(found)[3] if found else root.first("body") or root


def clean_lines(text: str) -> str:
    """Runs of blanks are one, lines without white space around them, no blank lines."""
    return "\n".join(s for x in text.split("\n") if (s := re.sub(" +", " ", x).strip())).strip()


def clean_text(root: Node) -> str:
    """The page's text without elements that are no content by kind, by name, or because they are hidden; a line a string. The tree
    is changed."""
    _strip(root, lambda n: n.tag in NO_CONTENT or _HIDDEN.search(n.attrs.get("style", "")) is not None or _has(n, "hidden"))
    main = find_main(root)
    _strip(main, named(_NO_CONTENT))
    return clean_lines(main.text("\n"))


def content(page: str, url: str, root: Node) -> dict:
    text = clean_text(root.copy())
    title = root.first("title") or root.first("h1")
    main = find_main(root)
    return {
        "text": text, "title": title.text() if title else "", "main_tag": main.tag.lstrip("#"), "paragraphs": sum(bool(p.strip()) for p in text.split("\n\n")),
        "links": [{"text": a.text(), "href": a.attrs["href"]} for a in root.all("a", where=lambda n: _has(n, "href"))[:10]],
        "images": [{"src": i.attrs["src"], "alt": i.attrs.get("alt", "")} for i in main.all("img", where=lambda n: _has(n, "src"))[:10]],
        "char_count": len(text), "word_count": len(text.split()),
    }


def quality(page: str, url: str, root: Node) -> dict:
    root = root.copy()
    _strip(root, lambda n: n.tag in QUALITY_DROPS)
    text, title = root.text(" "), root.first("title")
    return {
        "text": text, "text_length": len(text), "word_count": len(re.findall(r"\S+", text)), "has_title": title is not None, "title": title.text() if title else "",
        "has_main": root.first("main", "article") is not None, "image_count": len(root.all("img")), "link_count": len(root.all("a")),
    }


def snapshot(page: str, url: str, root: Node) -> dict:
    """Title, the main part's HTML without what frames it, and the length of its text."""
    root = root.copy()
    title = root.first("title")
    main = root.first("article") or root.first(where=has_class("content-wrap")) or root.first("body") or root
    framing = lambda n: n.tag in ("nav", "header", "footer", "script", "style") or n.attrs.get("id") in ("header", "footer", "lnb") or has_class("sub-top", "skip", "sr-only")(n) or {"snb", "lnb-wrapper"} <= set(n.classes)
    _strip(main, framing)
    return {"title": title.text() if title else "", "html": main.html(), "text_length": len(" ".join(main.text(" ").split()))}


def summary(page: str, url: str, root: Node) -> dict:
    """Title and text of the main part with addresses of mail out."""
    title = root.first("title")
    main = root.first(where=lambda n: n.tag == "article" or n.attrs.get("id") == "content" or has_class("contents", "board-view", "sub-contents")(n)) or root
    area = root.first(where=has_class("title-area"))
    text = re.sub(rf"\b{EMAIL}\b", EMAIL_MARK, " ".join(main.text(" ").split()))
    return {"title": title.text() if title else "", "title_area": area.text() if area else None, "text": text, "text_length": len(text)}


def redacted(page: str, url: str, root: Node) -> str:
    """The page with addresses of mail out of its text and links."""
    root = root.copy()
    for a in root.all("a", where=lambda n: n.attrs.get("href", "").startswith("mailto:")):
        a.children = [EMAIL_MARK]
        a.attrs |= {"href": url or "#", "data-redacted": "email"}
    return re.sub(rf"\b{EMAIL}\b", EMAIL_MARK, root.html())


def old(page: str, url: str, root: Node) -> dict:
    """What the older corpus took: addresses by which the page may go, its text, the element it came from, its date."""
    meta = lambda key, name: next((n.attrs["content"].strip() for n in root.all("meta", where=lambda n: n.attrs.get(key) == name and n.attrs.get("content"))), "")
    link = root.first("link", where=lambda n: "canonical" in n.attrs.get("rel", "").split())
    in_meta = [a.attrs["href"].strip() for a in root.all("a", where=lambda n: "http" in n.attrs.get("href", "") and inside(n, "div", where=has_class("meta")))]
    base = root.first("base")
    title = root.first("title")
    fetched = [m[1].split("T")[0] for d in root.all("div", where=has_class("meta")) if (m := re.search(r"Fetched at:\s*([\d\-T:]+)", d.text(" ")))]
    bare = root.copy()
    _strip(bare, lambda n: n.tag in OLD_DROPS or n.attrs.get("role") in OLD_ROLES)
    main = bare.first("main") or bare.first("article") or bare.first("section") or bare.first("body") or bare
    return {
        "canonical": (link.attrs.get("href", "") if link else "").strip(), "og_url": meta("property", "og:url"), "snapshot_link": in_meta[0] if in_meta else "", "base": base.attrs.get("href", "").strip() if base else "",
        "title": (title.text() if title else "") or meta("property", "og:title"), "text": main.text("\n"), "selector": main.tag.lstrip("#"), "fetched": fetched[0] if fetched else "",
    }


# links and files --------------------------------------------------------------------------------------------------------


def anchors(page: str, url: str, root: Node) -> list[dict]:
    return [{"href": a.attrs["href"].strip(), "abs_url": urljoin(url or "", a.attrs["href"].strip()), "text": a.raw().strip(), "class": " ".join(a.classes)} for a in root.all("a", where=lambda n: _has(n, "href"))]


def file_name(abs_url: str, link_text: str = "", disposition: str = "", content_type: str = "", image: bool = False) -> str:
    """A file's name: as the server says, or the end of its address, or the link's text where that ends in something, or a digest;
    an ending by the content's type where it has none."""
    if "filename=" in disposition:
        name = disposition.split("filename=")[-1].strip("\"'")
    else:
        name = abs_url.split("/")[-1].split("?")[0] or ("image" if image else "")
        if not image and ("." not in name or name.endswith(".do")):
            name = link_text if "." in link_text else f"file_{hashlib.md5(abs_url.encode()).hexdigest()[:8]}"
    name = unquote(name)
    if name.lower().endswith(".do") or "." not in name:
        ending = mimetypes.guess_extension(content_type.split(";")[0].strip()) or (".jpg" if image else "")
        name = os.path.splitext(name)[0] + {".jpe": ".jpg"}.get(ending, ending) if ending else name
    return name.replace("/", "_").replace("\\", "_")


def attachments(page: str, url: str, root: Node) -> list[dict]:
    """Links to files and pictures that are no icons."""
    out = []
    for a in root.all("a", where=lambda n: _has(n, "href")):
        href = a.attrs["href"]
        if ("download" in href.lower() or href.lower().endswith(DOWNLOAD_ENDS)) and not any(p in href for p in NO_DOWNLOAD):
            to, text = urljoin(url or "", href), a.text()
            out.append({"page_url": url, "link_text": text, "download_url": to, "type": "file", "status": "metadata_only", "filename": file_name(to, text)})
    for i in root.all("img", where=lambda n: _has(n, "src")):
        src = i.attrs["src"]
        if not any(x in src for x in ICONS):
            to = urljoin(url or "", src)
            out.append({"page_url": url, "link_text": i.attrs.get("alt", "").strip(), "download_url": to, "type": "image", "status": "metadata_only", "filename": file_name(to, image=True)})
    return out


def is_picture(src: str) -> bool:
    """The stricter test of department pages: an image's ending, or the editor's address."""
    bare = src.split("?", 1)[0].lower()
    return bare.endswith(IMAGE_ENDS) or EDITOR_IMAGE in bare


def article_links(page: str, url: str, root: Node) -> list[str]:
    """Addresses of a board's articles, newest first: by article number, or else the 20 with the largest numbers in them, or else
    the first 20."""
    every = [urljoin(url or "", h) for a in root.all("a", where=lambda n: _has(n, "href")) if (h := a.attrs["href"])]
    numbered = [u for u in every if "mode=view" in u and _NUMBER.search(u)]
    if numbered:
        return sorted(numbered, key=lambda u: -int(_NUMBER.search(u)[1]))
    largest = [(max(map(int, re.findall(r"\d+", u))), u) for u in every if re.search(r"\d", u)]
    return [u for _, u in sorted(largest, key=lambda x: -x[0])[:20]] if largest else every[:20]


# tables, boards, schedules, menus ---------------------------------------------------------------------------------------------


def tables_as_text(page: str, url: str, root: Node) -> str:
    """The page with each table written out between marks, a line a row, cells parted by bars."""
    root = root.copy()
    found = root.all("table")
    if not found:
        return page or ""
    for table in found:
        if not table.attached(root):
            continue
        rows = [" | ".join(cells) for tr in table.all("tr") if any(cells := [c.text() for c in tr.all("th", "td")])]
        if rows:
            table.tag, table.attrs = "div", {}
            table.children = ["\n".join(["", TABLE_MARKS[0], *rows, TABLE_MARKS[1], ""])]
    return root.html()


def board(page: str, url: str, root: Node) -> dict:
    """Title, author, views and date of a post, by the board's head; and the date by wider patterns, the head by its labels."""
    head = root.first("div", where=has_class("title-area"))
    title = next((t for tag in ("h4", "h3", "strong") if head and (n := head.first(tag)) and (t := n.text())), None)
    out = {"title": title, "author": None, "view_count": None, "created_at": None}
    info = root.first("div", where=has_class("board-view-information"))
    for dl in info.all("dl") if info else []:
        dt, dd = dl.first("dt"), dl.first("dd")
        if dt is None or dd is None:
            continue
        key, value = dt.text(), dd.text()
        if AUTHOR in key:
            out["author"] = value
        elif VIEWS in key:
            out["view_count"] = int(d) if (d := "".join(c for c in value if c.isdigit())) else out["view_count"]
        elif POSTED in key:
            out["created_at"] = _date(value) or out["created_at"]
    return out | {"any_date": any_date(root)} | {f"label_{k}": v for k, v in by_labels(root).items()}


def any_date(root: Node) -> str | None:
    """The first date in a definition, in something whose class speaks of dates, or in the page's own data."""
    places = [n.text() for n in root.all("dd")] + [n.text() for n in root.all(where=named("date|time", ("class",)))]
    places += [n.attrs.get("content", "") for n in root.all("meta", where=lambda n: n.attrs.get("property") in ("article:published_time", "article:modified_time"))]
    return next((d for t in places if (d := _date(t))), None)


def by_labels(root: Node) -> dict:
    """Author, views and date as the text of the element behind that which holds the label alone."""
    order = [root, *root.walk()]

    def behind(label: str) -> str | None:
        for k, n in enumerate(order):
            if any(isinstance(c, str) and c == label for c in n.children):
                return order[k + 1].text() if k + 1 < len(order) else None
        return None

    views, date = behind(VIEWS), (behind(POSTED) or "").replace(".", "-").strip()
    return {"author": behind(AUTHOR), "view_count": int(views) if views and views.isdigit() else None, "created_at": date if re.fullmatch(r"\d{4}-\d{1,2}-\d{1,2}", date) else None}


def schedule(page: str, url: str, root: Node) -> list[dict]:
    """Rows of a year's schedule; a row of two cells is of the month of the row before."""
    body = root.first("tbody", where=lambda n: inside(n, where=has_class("schedule-table")) and inside(n, where=has_class("year-schedule")))
    month, out = "", []
    for tr in body.all("tr") if body else []:
        cells = [c.text() for c in tr.all("td")]
        if len(cells) == 3:
            month = cells[0]
        if len(cells) in (2, 3) and cells[-1]:
            out.append({"month": month, "date": cells[-2], "content": cells[-1]})
    return out


def menu(page: str, url: str, root: Node) -> list[dict]:
    """(day, meal, items) of the menu table: days are the head's columns, a cell names its meal and lists its dishes; meals in
    the order in which they first occur."""
    table = next((t for t in root.all("table") if (c := t.first("caption")) and MENU_CAPTION in c.text()), None) or root.first("table")
    head, body = (table.first("thead"), table.first("tbody")) if table else (None, None)
    days = [t for th in (head.all("th") if head else []) if (t := th.text(" "))]
    cells: dict[tuple[int, int], list[str]] = {}
    meals: list[str] = []
    for tr in body.all("tr") if body else []:
        for k, td in enumerate(tr.all("td")[: len(days)]):
            p = td.first("p")
            meal, dishes = p.text() if p else "", [li.text() for li in td.all("li")]
            if meal and dishes:
                if meal not in meals:
                    meals.append(meal)
                cells.setdefault((k, meals.index(meal)), []).extend(dishes)
    return [{"day_pos": k, "day": day, "meal_pos": m, "meal": meals[m], "items": cells[k, m]} for k, day in enumerate(days) for m in range(len(meals)) if (k, m) in cells]


def lists(page: str, url: str, root: Node) -> dict:
    """Rows of a board, a menu and a schedule by the generic parsers, tables before lists."""
    in_body = lambda n: inside(n, "tbody") and inside(n, "table")
    posts = []
    for tr in root.all("tr", where=in_body):
        if a := tr.first("a", where=lambda n: _has(n, "href")):
            cells = tr.all("td")
            posts.append({"title": _flat(a), "url": urljoin(url or "", a.attrs["href"]), "date": _flat(cells[-1]) if cells else ""})
    if not posts:
        posts = [{"title": _flat(a), "url": urljoin(url or "", a.attrs["href"]), "date": None} for a in root.all("a", where=lambda n: _has(n, "href") and inside(n, "li") and inside(n, "ul"))]
    dishes = []
    for tr in root.all("tr", where=lambda n: inside(n, "table")):
        key, text = _flat(tr.first("th")), " / ".join(t for td in tr.all("td") if (t := _flat(td)))
        if key or text:
            dishes.append({"key": key or "-", "content": text})
    if not dishes:
        dishes = [{"key": "-", "content": t} for n in root.all(where=has_class("menu", "tbl_wrap", "contents")) if (t := _flat(n))]
    dates = [{"date": _flat(td.first(where=has_class("day", "date")) or td), "title": t} for td in root.all("td", where=lambda n: inside(n, "table")) for li in td.all("li") if (t := _flat(li))]
    return {"posts": posts, "dishes": dishes, "dates": dates}


def rows(page: str, url: str, root: Node) -> list[dict]:
    """(title, date) of a list's entries, each once, titles of two characters or more: rows of tables, or else entries of lists, or
    else divisions of a board."""
    squeeze = lambda n: " ".join(n.raw().split()) if n is not None else ""
    dated = lambda n: n.first(where=lambda x: x.tag == "time" or has_class("date")(x))
    link = lambda n: n.first("a", where=lambda x: _has(x, "href"))
    out = []
    for tr in root.all("tr", where=lambda n: inside(n, "tbody") and inside(n, "table")):
        if a := link(tr):
            last = [c for c in tr.walk() if has_class("date", "regDate")(c) or (c.tag == "td" and c is [x for x in c.parent.children if isinstance(x, Node)][-1])]
            out.append((squeeze(a), squeeze(last[0]) if last else ""))
    if not out:
        for li in root.all("li", where=lambda n: inside(n, "ul", "ol")):
            if a := link(li):
                m = re.search(r"\d{4}[-./]\d{1,2}[-./]\d{1,2}", " ".join(li.strings()))
                out.append((squeeze(a), squeeze(d) if (d := dated(li)) else m[0] if m else ""))
    if not out:
        for n in root.all("div", "li", where=lambda n: inside(n, "div", where=has_class("board_list"))):
            if a := link(n):
                out.append((squeeze(a), squeeze(dated(n))))
    return [{"title": t, "date": d} for t, d in dict.fromkeys(out) if len(t) >= 2]


def article(page: str, url: str, root: Node) -> str | None:
    """The page's article alone as a page of its own that keeps its relative links."""
    n = root.first("article")
    return f'<html lang="ko"><head><meta charset="utf-8"/><base href="{url or ""}"/></head><body>{n.html()}</body></html>' if n else None


#: What can be asked for: name, function of (page, url, tree), type.
PARTS = {
    "content": (content, "struct<text:string,title:string,main_tag:string,paragraphs:int,links:array<struct<text:string,href:string>>,images:array<struct<src:string,alt:string>>,char_count:int,word_count:int>"),
    "quality": (quality, "struct<text:string,text_length:int,word_count:int,has_title:boolean,title:string,has_main:boolean,image_count:int,link_count:int>"),
    "snapshot": (snapshot, "struct<title:string,html:string,text_length:int>"),
    "summary": (summary, "struct<title:string,title_area:string,text:string,text_length:int>"),
    "redacted": (redacted, "string"),
    "old": (old, "struct<canonical:string,og_url:string,snapshot_link:string,base:string,title:string,text:string,selector:string,fetched:string>"),
    "anchors": (anchors, "array<struct<href:string,abs_url:string,text:string,class:string>>"),
    "attachments": (attachments, "array<struct<page_url:string,link_text:string,download_url:string,type:string,status:string,filename:string>>"),
    "article_links": (article_links, "array<string>"),
    "tables": (tables_as_text, "string"),
    "board": (board, "struct<title:string,author:string,view_count:int,created_at:string,any_date:string,label_author:string,label_view_count:int,label_created_at:string>"),
    "schedule": (schedule, "array<struct<month:string,date:string,content:string>>"),
    "menu": (menu, "array<struct<day_pos:int,day:string,meal_pos:int,meal:string,items:array<string>>>"),
    "lists": (lists, "struct<posts:array<struct<title:string,url:string,date:string>>,dishes:array<struct<key:string,content:string>>,dates:array<struct<date:string,title:string>>>"),
    "rows": (rows, "array<struct<title:string,date:string>>"),
    "article": (article, "string"),
}


def parts(page: str | Column, url: str | Column, wanted: tuple[str, ...], closed: bool = False) -> Column:
    """A struct of the wanted parts. Ask only for what is needed: a part that is not asked for is not made. ``closed``: character
    references count only with their semicolon."""
    chosen = [(k, PARTS[k][0]) for k in wanted]

    def run(pages: list, urls: list) -> list:
        found = []
        for p, u in zip(pages, urls, strict=True):
            root = dom.parse(p or "", closed)
            found.append({k: f(p or "", u or "", root) for k, f in chosen})
            root.take_apart()
        return found

    c = lambda x: F.col(x) if isinstance(x, str) else x
    return sliced(run, "struct<" + ",".join(f"{k}:{PARTS[k][1]}" for k in wanted) + ">")(c(page).cast("string"), c(url).cast("string"))


def schedule_text(entries: Column) -> Column:
    """A schedule's entries as lines."""
    return F.array_join(F.transform(entries, lambda r: F.concat_ws(" | ", r["month"], r["date"], r["content"])), "\n")


def minimal_page(url: Column, title: Column, article_html: Column, fetched_at: Column) -> Column:
    """A small page around a snapshot's main part, with its origin."""
    head = F.format_string('<!doctype html>\n<html lang="ko">\n<head>\n  <meta charset="utf-8"/>\n  <meta name="viewport" content="width=device-width,initial-scale=1"/>\n  <base href="%s"/>\n  <title>%s</title>\n</head>\n', url, title)
    body = F.format_string('<body>\n  <div class="meta">Fetched at: %s</div>\n  %s\n  <hr/>\n  <div class="meta">Snapshot of <a href="%s">%s</a></div>\n</body>\n</html>', fetched_at, article_html, url, url)
    return F.concat(head, body)
