"""HTML main-text extraction by consensus host paths.

First pass: every page is parsed leniently, its containers are scored by the text they hold that
is neither boilerplate nor links, and the page votes for the generalised tag-class path of its best
one. Votes are summed per host in Spark. Second pass: the page's containers at its host's winning
path are extracted; a page without that path uses its own best container.

What is left out, wherever it stands: elements whose tag or role says that they are menus, headers,
footers, sidebars, notices, adverts, forms, scripts or styles; hidden elements; elements one of whose
class or id names has a SURE word, or has a USUAL word and besides only words that say nothing
(``cookie-notice``, ``comment-list``, but not ``notice-of-appeal``), unless they hold the main
heading. Names of WEAK words (``share``, ``tags``, ``byline``) need evidence: either all text of the
element is links, or the host's pages repeat one another's text at its path, which is counted in the
first pass. All else stays. Character references are decoded, white space inside a block is one
space, blocks follow in page order, joined by a line feed.

Defined results: null and empty html give empty text; a null url has the empty host; very long pages
are parsed whole, in time about in proportion; repeated rows are answered each; an empty table gives
an empty result; other columns are ignored, whatever their names. Memory is that of one page.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Collection, Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlens.llm.url_reputation import host_of
from emberlens.session import cut_lineage, ship_package

BROADCAST_HOSTS = 200_000
#: A tag with quoted values that may hold angle brackets, or else up to the next bracket; possessive, so
#: that broken markup costs no more than its length.
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:"[^"]*+"|'[^']*+'|[^<>"'])*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>""",
    re.S,
)
ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption option legend".split()
)
CONTAINER = frozenset("article blockquote body center dd div dl fieldset li main ol section table tbody td tr ul".split())
DROP_TAGS = frozenset("head nav header footer aside form script style title noscript template iframe embed textarea menu dialog search noembed noframes datalist".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert status".split())
SURE = frozenset("advert adverts advertisement advertisements advertising adsense adslot sidebar sidebars sidenav navbar breadcrumb breadcrumbs pagination outbrain taboola disqus commentlist masthead topbar gdpr popup".split())
USUAL = frozenset(
    "ad ads banner banners sponsor sponsored sponsors promo promos promotion cookie cookies consent notice notices notification notifications alert alerts modal overlay newsletter subscribe subscription signup login signin aside rail widget widgets menu menus nav navigation pager paging toolbar comment comments respond footer header search skip".split()
)
WEAK = frozenset("share sharing social related recommended recommendations teaser teasers reply replies discussion copyright legal tags tagcloud meta byline".split())
#: Words that say where or how an element stands, not what it holds.
NEUTRAL = frozenset(
    "area article bar blog bottom box btn button buttons close col column container content desktop div entry fixed float form global google group gpt head icon icons inline inner input item items js label left like link links list main media mobile module outer page panel post posts primary region right row secondary section site slot small sticky story strip submit text thread title top unit user view wrap wrapper".split()
)
#: Pages of a host with text at one weak path from which on repeats count, and how many each text has on
#: the average for the path to be boilerplate.
EVIDENCE, REPEATS = 3, 2
#: Prefixes of class names that tell a state of an element, not what it is.
STATES = ("has-", "no-", "is-", "with-", "js-", "without-")
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend"}
#: A start tag of the key closes an open element of the values, up to the nearest of the stops.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}


@lru_cache(maxsize=50_000)
def kind_of(token: str) -> str | None:
    """``drop`` or ``weak`` by the words of a class or id name, else None."""
    words = [w.lower() for w in WORDS.findall(token)]
    if any(w in SURE for w in words):
        return "drop"
    telling = [w for w in words if len(w) > 1 and w not in NEUTRAL]
    if not telling or any(w not in USUAL and w not in WEAK for w in telling):
        return None
    return "drop" if any(w in USUAL for w in telling) else "weak"


class Page:
    """Elements of one page in order of their start tags, and its pieces of text."""

    def __init__(self, source: str):
        self.parent, self.tag, self.name, self.drop = [-1], ["#root"], [""], [False]
        self.unless = [False]  # dropped by its words alone, which a main heading inside overrules
        self.weak: list[int] = []
        self.texts: list[tuple[int, str]] = []  # (element, text); a block boundary is (-1, "")
        self._read(source)
        self._settle()

    def _open(self, tag: str, attrs: str, top: int) -> int:
        names, drop, by_words, css = [], tag in DROP_TAGS, False, ""
        if attrs and not attrs.isspace():
            for m in ATTR.finditer(attrs):
                key = m[1].lower()
                if key not in ("class", "id", "role", "hidden", "style", "aria-hidden"):
                    continue
                value = m[2] or m[3] or m[4] or ""
                if key == "class":
                    css = value
                    names.append(value)
                elif key == "id":
                    names.append(value)
                elif key == "role":
                    drop |= value.strip().lower() in DROP_ROLES
                elif key == "hidden":
                    drop |= value.lower() != "until-found"
                elif key == "aria-hidden":
                    drop |= value.strip().lower() == "true"
                else:
                    drop |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            if names and tag not in ("body", "html", "main"):
                tokens = [t for n in names for t in n.split() if not t.lower().startswith(STATES)]
                if tag == "article":  # what kind it is comes first; the rest tells its state
                    tokens = tokens[:1]
                kinds = {kind_of(t) for t in tokens}
                by_words = "drop" in kinds
                if "weak" in kinds and not by_words and not drop:
                    self.weak.append(len(self.tag))
        first = css.split()[0] if css.split() else ""
        self.parent.append(top)
        self.tag.append(tag)
        self.name.append(re.sub(r"\d+", "#", first))
        self.drop.append(drop)
        self.unless.append(by_words and not drop)
        return len(self.tag) - 1

    def _close_to(self, stack: list[int], tags: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            t = self.tag[stack[k]]
            if t in tags:
                del stack[k:]
                return
            if t in stops:
                return

    def _read(self, source: str) -> None:
        stack, at, n = [0], 0, len(source)
        texts, tags = self.texts, self.tag
        while at < n:
            m = TOKEN.search(source, at)
            begin = m.start() if m else n
            if begin > at:
                texts.append((stack[-1], source[at:begin]))
            if not m:
                break
            at = m.end()
            tag, slash, attrs = m[2] or m[5], m[1] or m[4], m[3] if m[2] else m[6]
            if not tag:
                continue
            tag = tag.lower()
            block = tag in BLOCK
            if block:
                texts.append((-1, ""))
            if slash:
                stops = frozenset() if block and tag != "p" else CONTAINER if tag == "p" else BLOCK
                self._close_to(stack, {tag}, stops)
                continue
            if tag == "br":
                texts.append((stack[-1], " "))
            if tag in CLOSES_P:
                self._close_to(stack, {"p"}, CONTAINER | {"button"})
            if tag in SIBLINGS:
                self._close_to(stack, *SIBLINGS[tag])
            if tag in VOID or (attrs or "").endswith("/") and tag not in BLOCK and tag not in RAW:
                continue
            node = self._open(tag, attrs or "", stack[-1])
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                if tag not in DROP_TAGS:
                    texts.append((node, source[at : end.start() if end else n]))
                at = end.end() if end else n
                continue
            stack.append(node)

    def drop_weak(self, spots: Collection[str]) -> None:
        """Weak elements at the given spots go."""
        gone = [i for i in self.weak if self.spot(i) in spots]
        if gone:
            for i in gone:
                self.drop[i] = True
            self._settle()

    def _settle(self) -> None:
        parent, tag = self.parent, self.tag
        heads = [False] * len(tag)  # holds a main heading or the main element
        for i in range(len(tag) - 1, 0, -1):
            if tag[i] in ("h1", "main"):
                heads[i] = True
            if heads[i]:
                heads[parent[i]] = True
        mass, linked, links = [0] * len(tag), [0] * len(tag), [False] * len(tag)
        for i in range(1, len(tag)):
            self.drop[i] = self.drop[i] or self.drop[parent[i]] or (self.unless[i] and not heads[i])
            links[i] = tag[i] == "a" or links[parent[i]]
        for i, t in self.texts:
            if i >= 0 and not self.drop[i]:
                (linked if links[i] else mass)[i] += len(t.strip())
        for i in range(len(tag) - 1, 0, -1):
            mass[parent[i]] += mass[i]
            linked[parent[i]] += linked[i]
        self.mass = mass
        menus = [i for i in self.weak if not self.drop[i] and linked[i] and not mass[i] and not links[i]]
        if menus:  # weak elements of links alone
            for i in menus:
                self.drop[i] = True
            for i in range(1, len(tag)):
                self.drop[i] = self.drop[i] or self.drop[parent[i]]

    def spot(self, i: int) -> str:
        """The path of an element that may be no container."""
        return f"{self.path(self.parent[i])}>{self.tag[i]}.{self.name[i]}"

    def weak_texts(self) -> list[tuple[str, str]]:
        """(spot, text) of the weak elements that stand."""
        return [(self.spot(i), t) for i in self.weak if not self.drop[i] and (t := self.text(i))]

    def path(self, i: int) -> str:
        steps = []
        while i > 0:
            if self.tag[i] in CONTAINER:
                steps.append(f"{self.tag[i]}.{self.name[i]}" if self.name[i] else self.tag[i])
            i = self.parent[i]
        return "/".join(reversed(steps))

    def best(self) -> int:
        """The article with most text, else the main element, else the deepest container outside of
        which no text is left that is neither boilerplate nor links."""
        for kind in ("article", "main"):
            named = [i for i, t in enumerate(self.tag) if t == kind and not self.drop[i] and self.mass[i]]
            if named:
                return max(named, key=lambda i: (self.mass[i], -i))
        inner: dict[int, list[int]] = {}
        for i in range(1, len(self.tag)):
            if not self.drop[i] and self.mass[i]:
                inner.setdefault(self.parent[i], []).append(i)
        at = found = 0
        while at in inner:
            child = max(inner[at], key=lambda i: (self.mass[i], -i))
            if self.mass[child] < self.mass[at]:
                break
            at = child
            if self.tag[at] in CONTAINER and self.tag[at] not in ("ul", "ol", "dl", "table", "tbody", "tr", "li", "dd", "blockquote"):
                found = at
        return found

    def at_path(self, path: str) -> list[int]:
        """The elements with text at a path, in page order."""
        last = path.rpartition("/")[2].partition(".")[0]
        return [i for i, t in enumerate(self.tag) if t == last and not self.drop[i] and self.mass[i] and self.path(i) == path]

    def text(self, *tops: int) -> str:
        inside = [False] * len(self.tag)
        for i in tops:
            inside[i] = True
        for i in range(1, len(self.tag)):
            inside[i] = inside[i] or inside[self.parent[i]]
        blocks, part = [], []
        for i, t in [*self.texts, (-1, "")]:
            if i < 0:
                if part:
                    blocks.append(" ".join(entities.unescape("".join(part)).split()))
                    part = []
            elif inside[i] and not self.drop[i]:
                part.append(t)
        return "\n".join(b for b in blocks if b)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, path, weight of each page's vote; and host, path, text (a hash) of its weak elements."""
    for b in batches:
        rows: list[tuple[str, str, int | None, int | None]] = []
        for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            page = Page(source)
            best = page.best()
            rows.append((host, page.path(best), int(1000 * math.log1p(page.mass[best])), None))
            rows += [(host, spot, None, int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), signed=True)) for spot, text in page.weak_texts()]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["host", "path", "weight", "text"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for path, weak, source in zip(b.column("path").to_pylist(), b.column("weak").to_pylist(), b.column("html").to_pylist(), strict=True):
            if not source:
                texts.append("")
                continue
            page = Page(source)
            if weak:
                page.drop_weak(set(weak))
            at = page.at_path(path) if path else []
            if not at:
                best = page.best()
                at = page.at_path(page.path(best)) or [best]
            texts.append(page.text(*at))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, weak: the path that wins the votes of each host's pages, ties to the first path, and
    the spots of weak elements whose texts repeat over its pages."""
    ship_package(pages.sparkSession)
    d = pages.select(F.col(url_col).alias("_url"), F.col(html_col).alias("html")).where("html is not null and html <> ''")
    seen = d.select(host_of(F.col("_url")).alias("host"), "html").mapInArrow(_vote, "host string, path string, weight bigint, text bigint")
    seen = cut_lineage(seen.groupBy("host", "path", "text").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")))
    votes = seen.where("text is null and weight > 0").groupBy("host").agg(F.min_by("path", F.struct(-F.col("weight"), "path")).alias("path"))
    spots = seen.where("text is not null").groupBy("host", "path").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).where((F.col("n") >= EVIDENCE) & (F.col("n") >= REPEATS * F.col("texts")))
    return votes.join(spots.groupBy("host").agg(F.collect_list("path").alias("weak")), "host", "left")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """page id, url, text, n_chars of every page."""
    winners = cut_lineage(host_paths(pages, url_col, html_col))
    few = winners.count() <= broadcast_hosts
    d = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("host", host_of(F.col("_url")))
    d = d.join(F.broadcast(winners) if few else winners, "host", "left").select("id", F.col("_url").alias("url"), "html", "path", "weak")
    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(_extract, f"id {kind}, url string, text string, n_chars bigint").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
