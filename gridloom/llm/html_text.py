"""Main text of web pages by consensus of each host's pages.

Every page scores its containers by the plain text that they hold near the top,
less link text.  The best vote for their path of tags and classes, digits
generalised, and votes are added up per host.  Pages are then extracted from the
containers on the host's winning path; a page without them uses its own best.

Class words such as "sidebar" decide nothing alone: an element so named counts
a fifth and is left out of what surrounds it, but it may win a page or a host,
and what lies on the winning path is content on all pages of the host.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, lookup, stage

#: Winning paths (one a host) are broadcast as far as hosts and paths take so many bytes.
BROADCAST_BYTES = 30_000_000
#: Score of what stands in an element whose name speaks of boilerplate, for each such element around it.
SUSPECT = 0.2
#: Tags that the quoted pattern may fail on before quotes no longer count in a page; each failure may scan it once.
TRIES = 100
_START = re.compile(r"<(?:!--|[!?]|/?[A-Za-z])")
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/<>]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+)>")
_BARE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/<>]*)([^<>]*)>")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg canvas object textarea title xmp noembed noframes".split())
BLOCK = set("html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption hr address header footer nav aside form fieldset details summary center hgroup".split())
DROPPED = set("head nav footer aside button select option dialog menu audio video map label annotation annotation-xml".split()) | RAW
CONTAINERS = set("html body article section main div td center blockquote".split())
_CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_AUTO = {k: (a.split(), b.split()) for k, (a, b) in _CLOSES.items()}
_P_ENDS = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_SCOPE = set("article section main div td th table body html header footer nav aside form blockquote".split())
_BAD = set("nav navbar navigation menu menubar footer sidebar ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login comment comments commentlist reply replies respond responses disqus discussion share sharing social related recommended breadcrumb breadcrumbs popup modal overlay widget pagination pager toolbar masthead topbar skip".split())
_MAYBE_BAD = {"header", "side", "aside", "bottom", "top", "tags", "meta", "form", "search"}
_GOOD = set("article content post entry story main text body".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar"}
_SUSPECT_ROLES = {"form", "alert", "dialog"}
#: A class that begins so speaks of what is elsewhere: has-sidebar, no-ads.
_ELSEWHERE = set("has with no not without".split())
_ABOUT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_FINE, _SUSPECTED, _GONE = range(3)


class Page:
    """Containers and text blocks of one page: nodes (parent, tag, step, good, suspected) and blocks (node, text, link characters)."""

    def __init__(self, source: str | None):
        self.nodes: list[tuple[int, str, str, int, bool]] = [(-1, "", "", 0, False)]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(source or "")
        self.paths, self.doubts = [b""], [0]
        for parent, _, step, _, suspected in self.nodes[1:]:
            self.paths.append(hashlib.blake2b(self.paths[parent] + step.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            self.doubts.append(self.doubts[parent] + suspected)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, bool]] = []  # tag, node, dropped
        open_at: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack by tag
        scopes: list[int] = []
        parts: list[str] = []
        linked, links, dropped, inside, holder = 0, 0, 0, 0, 0
        at, begin, end_of_source, last, tries = 0, 0, len(source), source.rfind(">"), TRIES
        nodes, blocks = self.nodes, self.blocks
        endless: set[str] = set()

        def flush() -> None:
            nonlocal linked
            if parts:
                if text := " ".join(_html.unescape("".join(parts)).split()):
                    blocks.append((holder, text, linked))
                parts.clear()
            linked = 0

        def pop() -> None:
            nonlocal links, dropped, inside, holder
            tag, node, drop = stack.pop()
            open_at[tag].pop()
            if tag in _SCOPE:
                scopes.pop()
            if tag in BLOCK or (node >= 0 and nodes[node][4]):
                flush()
            links -= tag == "a"
            dropped -= drop
            inside -= tag in ("article", "main")
            if node >= 0:
                holder = nodes[node][0]

        def nearest(tags) -> int:
            return max((open_at[t][-1] for t in tags if open_at[t]), default=-1)

        def take(text: str) -> None:
            nonlocal linked
            if text and not dropped:
                parts.append(text)
                if links:
                    linked += len(text)

        while begin < end_of_source:
            m = _START.search(source, at)
            if m and m[0] != "<!--" and m.start() > last:
                m = None  # nothing ends the tags from here on
            if not m:
                comment = source.find("<!--", at)
                take(source[begin : comment if comment >= 0 else end_of_source])
                break
            start = m.start()
            if m[0] == "<!--":
                take(source[begin:start])
                close = source.find("-->", start + 2)
                at = begin = close + 3 if close >= 0 else end_of_source
                continue
            if m[0][1] in "!?":
                take(source[begin:start])
                at = begin = source.index(">", start) + 1
                continue
            t = _TAG.match(source, start) if tries else None
            if not t:
                tries = max(0, tries - 1)
                t = _BARE_TAG.match(source, start)
            if not t:
                at = start + 1
                continue
            take(source[begin:start])
            at = begin = t.end()
            tag = t[2].lower()
            if t[1]:
                if open_at[tag]:
                    while stack[-1][0] != tag:
                        if tag not in BLOCK and stack[-1][0] in BLOCK:
                            break  # an inline end tag doesn't end a block
                        pop()
                    if stack[-1][0] == tag:
                        pop()
                elif tag in BLOCK:
                    flush()
                continue
            if tag in ("br", "hr"):
                parts.append(" ") if tag == "br" and not dropped else flush()
                continue
            if tag in VOID:
                continue
            if tag in _AUTO:
                ends, scope = _AUTO[tag]
                while (k := nearest(ends)) > nearest(scope):
                    while len(stack) > k:
                        pop()
            elif tag in _P_ENDS and open_at["p"] and open_at["p"][-1] > (scopes[-1] if scopes else -1):
                k = open_at["p"][-1]
                while len(stack) > k:
                    pop()
            if tag in RAW:
                end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                if end or tag in ("script", "style", "textarea", "title"):
                    at = begin = end.end() if end else end_of_source
                    continue
                endless.add(tag)
            if tag in BLOCK:
                flush()
            state, step, good = self._judge(tag, t[3], inside)
            drop, node = state == _GONE, -1
            if not dropped and not drop and (tag in CONTAINERS or state == _SUSPECTED):
                if state == _SUSPECTED:
                    flush()
                node = len(nodes)
                nodes.append((holder, tag, step, good, state == _SUSPECTED))
                holder = node
            open_at[tag].append(len(stack))
            if tag in _SCOPE:
                scopes.append(len(stack))
            stack.append((tag, node, drop))
            links += tag == "a"
            dropped += drop
            inside += tag in ("article", "main")
        flush()

    @staticmethod
    def _judge(tag: str, attributes: str, inside: int) -> tuple[int, str, int]:
        """Whether an element is dropped or suspected, its step in a path, and its bonus."""
        found = {k.lower(): (v[1:-1] if v[:1] in "\"'" else v) for k, v in _ATTR.findall(attributes)} if attributes.strip() else {}
        classes = found.get("class", "").split()
        named = [[w.lower() for w in _ABOUT.findall(x)] for x in (*classes, found.get("id", ""))]
        words = {w for x in named if x and x[0] not in _ELSEWHERE for w in x}
        good = len(words & _GOOD) + 6 * (tag in ("article", "main"))
        step = "/" + tag + "".join("." + re.sub(r"\d+", "#", c) for c in sorted(classes))
        role = found.get("role", "")
        drop = tag in DROPPED or (tag == "header" and not inside) or "hidden" in found or role in _ROLES
        if drop or "display:none" in found.get("style", "").replace(" ", "").lower() or found.get("aria-hidden", "") == "true":
            return _GONE, step, good
        if tag in ("html", "body", "article", "main"):
            return _FINE, step, good
        suspected = tag == "form" or role in _SUSPECT_ROLES or words & _BAD or (words & _MAYBE_BAD and not inside and not words & _GOOD)
        return _SUSPECTED if suspected else _FINE, step, good

    def scores(self) -> dict[int, float]:
        """Containers with text: each block counts in full where it stands and less in what is around that, as far as the nearest suspected element."""
        score: dict[int, float] = {}
        for node, text, linked in self.blocks:
            value, share = max(0.0, len(text) - 2.0 * linked) + 5.0, 1.0
            while node >= 0 and share > 1e-6:
                score[node] = score.get(node, 0.0) + value * share
                share *= 0.75
                node = -1 if self.nodes[node][4] else self.nodes[node][0]
        return {n: s * (1 + 0.25 * self.nodes[n][3]) * SUSPECT ** self.doubts[n] for n, s in score.items()}

    def best(self, count: int = 3) -> list[tuple[int, float]]:
        """The containers with the highest scores; suspected ones are none of them where an article or main element stands outside."""
        marked = any(tag in ("article", "main") and not self.doubts[n] for n, (_, tag, *_) in enumerate(self.nodes))
        scores = {n: s for n, s in self.scores().items() if not (marked and self.doubts[n])}
        return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:count]

    def text(self, path: bytes | None) -> str:
        """Blocks of the containers on the path or, without such, of the best container, joined by line feeds."""
        chosen = {n for n, p in enumerate(self.paths) if p == path} or {n for n, _ in self.best(1)}
        under: list[bool] = []
        for n, (parent, *_, suspected) in enumerate(self.nodes):
            under.append(n in chosen or (parent >= 0 and under[parent] and not suspected))
        return "\n".join(text for node, text, _ in self.blocks if under[node])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    r"""One row per page: key, url, text and n_chars.

    Blocks are joined by one \n; white space inside a block becomes one space.
    Null and empty pages give empty text.  Pages without a host (null or odd
    URLs) use their own best container.  Equal votes go to the larger path
    digest.  Pages take time in proportion to their length, whatever is unclosed
    in them.  Repeated rows are pages of their own.  An empty table gives an empty
    result; other columns are not read.
    """
    import pyarrow as pa

    host = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.nullif(host, F.lit("")).alias("host"), F.col(source).alias("html"))

    def vote(batches):
        for batch in batches:
            hosts, paths, votes = [], [], []
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = Page(t.as_py())
                ranked = page.best()
                total = sum(s for _, s in ranked) or 1.0  # deep in suspected elements it may vanish
                for place, (node, s) in enumerate(ranked):
                    hosts.append(h)
                    paths.append(page.paths[node])
                    votes.append(round(1000 * s / total) + 1000 * (place == 0))
            yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(paths, pa.binary()), pa.array(votes, pa.int64())], ["host", "path", "votes"])

    votes = rows.where(F.col("host").isNotNull()).select("host", "html").mapInArrow(vote, "host string, path binary, votes bigint")
    by_path = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.count("*").alias("n"))
    winners = by_path.groupBy("host").agg(F.max(F.struct("votes", "path")).alias("best"), F.sum("n").alias("n"))
    winners = stage(winners.select("host", F.col("best.path").alias("path"), "n"), "op10")
    total, size = winners.agg(F.sum("n"), F.sum(F.octet_length("host") + 40)).first()
    if (size or 0) <= BROADCAST_BYTES:
        small = F.broadcast(winners.select(F.col("host").alias("_host"), "path"))
        joined = rows.join(small, F.col("host") == F.col("_host"), "left")
    else:
        joined = lookup(rows, "host", winners, "host", F.col("n") >= F.lit(total // HOT_KEYS + 1))

    def run(batches):
        for batch in batches:
            texts = [Page(t.as_py()).text(p) for t, p in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    out = joined.select("id", "url", "html", "path").mapInArrow(run, f"id {pages.schema[key].dataType.simpleString()}, url string, text string, n_chars bigint")
    return out.withColumnRenamed("id", key)
