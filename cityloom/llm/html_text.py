"""Main text of web pages by consensus host paths.

First pass: each page's containers are scored by the text they hold, how much of
it stands in links and how many paragraphs it has; the page votes for the path
of its best container.  A path is the chain of tags with their class names,
digits taken out, so that pages of one template share it; it is known by a hash
that each element makes of its parent's.  Votes are summed per host and path in
Spark.  Second pass: a page is extracted again from the container on its host's
winning path, if it has one there that holds a fair share of its text; else from
its own best container.

Inside the container, menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments are left out; headings of the
article's own header stay.  Names of elements decide where they can only mean
that, and a form or an element named for the layout ("page-with-sidebar") that
holds nearly all text is none of them.  Of names that mean other things too ("related-work", "share-of-market")
the host decides: blocks on one path that mostly hold a text of their own, in
sentences rather than links, are article; those with the same text on most pages
aren't.  Where a host shows fewer than MIN_SEEN of them, a block counts by its
own text.  Character references are decoded, white space within a block becomes
one space, blocks are joined by an empty line.

Null or empty html, and pages without text, give an empty text.  A null URL or
one without host forms a host of its own name "".  Rows are extracted one by
one: repeated pages give repeated texts, and vote as often.  Of paths with equal
votes that with the higher scores wins, then the larger hash.  Unclosed and
misnested tags are closed as browsers do for paragraphs, list items, cells and
options.  A quote that isn't closed within its tag (none follows, or what
follows it can't follow an attribute) ends with the tag, so that no text is
swallowed and no markup kept.  Time and memory grow with a page's length,
however it is malformed.
"""

from __future__ import annotations

import gc
import html as entities
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityloom.session import BROADCAST_LIMIT_BYTES, fresh, stored

#: A winning path needs so many of its host's pages, and the container so much of the best score.
MIN_VOTES, MIN_SHARE, MIN_OF_BEST = 2, 0.25, 0.3
#: Blocks on one path of a host from which their host judges them; share of texts of their own and of prose that makes them article.
MIN_SEEN, OWN_SHARE = 3, 0.5
#: Characters outside links that make a block prose, and the most of its text that may stand in links.
PROSE_CHARS, PROSE_LINKS = 80, 0.3
#: Share of a page's text outside links and asides that makes a form, or an element named for the layout, the page's wrapper.
WRAPPED = 0.8

# HTML's void elements, raw-text elements, block elements and what they close.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp template svg math".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - frozenset("body dd dt html li tbody td tfoot th thead title tr".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "tfoot": ("table",), "option": ("select", "datalist")}
P_SCOPE = frozenset("body html table td th caption button object article section div main aside li blockquote".split())
# Elements and class or id words that mark what isn't the article.
SKIP_TAGS = frozenset("nav footer aside form button select menu dialog head script style noscript iframe template svg math textarea object embed canvas audio video input label".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
SKIP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion promoted banner billboard nav navbar navigation menu menus breadcrumb breadcrumbs topbar masthead sitenav pager pagination "
    "header footer foot colophon sidebar sidebars side rail widget widgets related recommended recommendations popular trending share sharing social follow newsletter subscribe subscription signup login register cookie cookies consent gdpr notice notices alert popup modal overlay paywall disclaimer "
    "comment comments commentlist discussion disqus replies respond feedback form search searchbox toolbar skip tags copyright legal".split()
)
#: Where a container may be: its path is voted on.
CONTAINERS = frozenset("article main section div td body blockquote center".split())
KEEP_WORDS = frozenset("article content main post entry story body text".split())
#: Words that mark other things too: they count only where no word of KEEP_WORDS stands beside them.
VAGUE_WORDS = frozenset("header foot form rail side banner tags alert feedback discussion widget promoted trending popular legal".split())
#: Of these a name of several words says little: the host decides.
WEAK_WORDS = frozenset("related recommended recommendations popular trending share sharing social follow tags feedback discussion legal copyright side search promoted promotion".split())
COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus replies respond feedback".split())
PARAGRAPHS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

OPENING = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)|(!--)|[!?])")
#: One attribute or the tag's end; every part takes what it can and gives nothing back, so that no page makes it retry.
ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|((?!["'])[^\s>]*+)))?+)""")
OPEN_QUOTE = re.compile(r"""\s*+=\s*+["']""")
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
DIGITS = re.compile(r"\d+")
SPACE = re.compile(r"\s+")
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
READ = frozenset("class id role hidden aria-hidden style".split())
NOTHING: frozenset[str] = frozenset()


class Node:
    """An element that matters for the text; others leave their text to the element around them."""

    __slots__ = ("tag", "name", "parent", "key", "depth", "skip", "soft", "weak", "within", "wrapper", "article", "words", "start", "stop", "chars", "linked", "para", "score")

    def __init__(self, tag: str, name: str, parent: Node | None, depth: int, start: int, skip: bool = False, article: bool = False, soft: bool = False, weak: bool = False, words: frozenset[str] = NOTHING):
        self.tag, self.name, self.parent, self.depth, self.start, self.skip, self.article, self.soft, self.weak, self.words = tag, name, parent, depth, start, skip or soft, article, soft, weak, words
        self.key = xxhash.xxh64_intdigest(name, parent.key) if parent is not None else 0
        self.within = parent is not None and (parent.within or parent.weak)  # a weakly named element around it
        self.stop = self.chars = self.linked = self.para = 0
        self.score = 0.0
        self.wrapper = False


def path_of(node: Node) -> str:
    names: list[str] = []
    at: Node | None = node
    while at is not None and at.parent is not None:
        names.append(at.name)
        at = at.parent
    return "".join("/" + n for n in reversed(names))


def tag_end(source: str, at: int) -> tuple[int, dict[str, str] | None]:
    """Place after a start tag whose name ends here, and the attributes that are read; the source's end if the tag has none."""
    if source.startswith(">", at):
        return at + 1, None
    found: dict[str, str] = {}
    while True:
        m = ATTRIBUTE.match(source, at)
        if m is None:
            return len(source), found
        if m[1]:
            return m.end(), found
        value, at = m[3] if m[3] is not None else m[4], m.end()
        if value is None:
            if m[5] is None and OPEN_QUOTE.match(source, at):  # no such quote follows
                close = source.find(">", at)
                return (len(source) if close < 0 else close + 1), found
            value = m[5] or ""
        elif ">" in value and at < len(source) and source[at] not in "/> \t\r\n\f":
            close = source.find(">", m.start(3) if m[3] is not None else m.start(4))
            return close + 1, found
        name = m[2].lower()
        if name in READ and name not in found:
            found[name] = value


def is_skipped(tag: str, attrs: dict[str, str] | None, article: bool) -> bool:
    """Left out for what the element is."""
    if tag in SKIP_TAGS or (tag == "header" and not article):
        return True
    return bool(attrs) and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in SKIP_ROLES or HIDDEN.search(attrs.get("style", "")) is not None)


def named_aside(tag: str, label: str, words: frozenset[str]) -> int:
    """1: left out for its class or id, unless an article turns out to stand within; 2: its host decides; 0: neither."""
    found = words & SKIP_WORDS
    if not found or tag in ("body", "html", "main") or tag in HEADINGS:
        return 0
    if tag == "article":
        return int(bool(words & {"comment", "comments"}))
    if not found - VAGUE_WORDS and words & KEEP_WORDS:
        return 0
    for token in label.split():
        own = frozenset(WORD.findall(CAMEL.sub(" ", token).lower()))
        said = own & SKIP_WORDS
        if said and (said - WEAK_WORDS or len(own) == 1):
            return 1
    return 2


def may_wrap(label: str) -> bool:
    """Whether a name that marks an aside may be a layout's: every such word has others beside it, and none is of reader comments."""
    for token in label.split():
        own = frozenset(WORD.findall(CAMEL.sub(" ", token).lower()))
        if own & SKIP_WORDS and (len(own) == 1 or own & COMMENT_WORDS):
            return False
    return True


class Page:
    """A page as a list of events: texts, and each element where it starts and where it ends.  Raw-text elements are left out.

    An element knows the places of its two events; no element holds its children,
    so that nothing is nested however deep the page is.
    """

    def __init__(self, source: str):
        self.root = root = Node("", "", None, 0, 0)
        self.events: list = [root]
        self.nodes: list[Node] = []
        events, stack, at, end = self.events, [root], 0, len(source)
        open_at: dict[str, list[int]] = {}  # places in the stack of open elements, by tag
        block_at: list[int] = []
        scope_at: list[int] = []
        soft_at: list[int] = []
        link = 0  # size of the stack when the open link began

        def last(tags: tuple[str, ...]) -> int:
            return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

        def close(to: int) -> None:
            nonlocal link
            while len(stack) > to:
                n = stack.pop()
                n.stop = len(events)
                events.append(n)
                open_at[n.tag].pop()
                if n.tag in BLOCK:
                    block_at.pop()
                if n.tag in P_SCOPE:
                    scope_at.pop()
                if soft_at and soft_at[-1] == len(stack):
                    soft_at.pop()
            if link > to:
                link = 0

        def text(a: int, b: int) -> None:
            piece, top = source[a:b], stack[-1]
            events.append(piece)
            if not piece.isspace():
                top.chars += b - a
                if link:
                    top.linked += b - a

        while at < end:
            m = OPENING.search(source, at)
            if m is None:
                text(at, end)
                break
            if at < m.start():
                text(at, m.start())
            at = m.end()
            tag = m[2]
            if tag is None:
                close_at = source.find("-->", m.start() + 2) if m[3] else source.find(">", at)
                at = end if close_at < 0 else close_at + (3 if m[3] else 1)
                continue
            tag = tag.lower()
            if m[1]:
                close_at = source.find(">", at)
                at = end if close_at < 0 else close_at + 1
                if tag == "a":
                    link = 0
                if open_at.get(tag):
                    i = open_at[tag][-1]
                    if tag in BLOCK or not (block_at and block_at[-1] > i):  # an inline end tag doesn't close a block
                        close(i)
                elif tag == "p":  # counts as an empty paragraph
                    node = Node(tag, tag, stack[-1], len(stack), len(events))
                    node.stop = node.start
                    events.append(node)
                continue
            at, attrs = tag_end(source, at)
            if tag in RAW:
                m = RAW_END[tag].search(source, at)
                at = m.end() if m else end
                continue
            if tag in CLOSES_P:
                p = open_at.get("p")
                if p and not (scope_at and scope_at[-1] > p[-1]):
                    close(p[-1])
            if tag in SIBLINGS:
                i = last(SIBLINGS[tag])
                while i and i > last(SCOPE[tag]):  # the outermost of those that end here
                    close(i)
                    i = last(SIBLINGS[tag])
            if tag == "a":
                link = len(stack)
            words, label = NOTHING, ""
            if attrs and ("class" in attrs or "id" in attrs):
                label = f"{attrs.get('class', '')} {attrs.get('id', '')}"
                words = frozenset(WORD.findall(CAMEL.sub(" ", label).lower()))
            top = stack[-1]
            skip = is_skipped(tag, attrs, top.article)
            aside = named_aside(tag, label, words) if words else 0
            wrapper = aside == 1 and may_wrap(label)
            if tag == "form" and (wrapper or aside != 1) and not is_skipped("div", attrs, top.article):
                skip, aside, wrapper = False, 1, True
            block = tag in BLOCK
            if not (block or skip or aside or tag in CONTAINERS or tag == "br" or open_at.get(tag)):
                continue
            name = tag + "".join("." + DIGITS.sub("", c) for c in sorted(attrs["class"].split())) if attrs and "class" in attrs else tag
            i = len(stack)
            node = Node(tag, name, top, i, len(events), skip, top.article or tag == "article" or tag == "main", aside == 1, aside == 2 and not skip and not (top.weak or top.within), words)
            node.wrapper = wrapper and not skip
            if soft_at and tag in ("article", "main") and not node.skip:  # a wrapper named for its layout, as in "with-sidebar"
                for k in soft_at:
                    stack[k].skip = stack[k].soft = False
                soft_at.clear()
            events.append(node)
            self.nodes.append(node)
            if tag in VOID or source[at - 2 : at] == "/>":
                node.stop = node.start
                continue
            open_at.setdefault(tag, []).append(i)
            if block:
                block_at.append(i)
            if tag in P_SCOPE:
                scope_at.append(i)
            if node.soft:
                soft_at.append(i)
            stack.append(node)
        close(1)
        root.stop = len(events)
        events.append(root)

    def unwrap(self) -> None:
        """A form, or an element named for the page's layout, that holds nearly all text outside links is no aside."""
        if not any(n.wrapper and n.skip for n in self.nodes):
            return
        held = {id(n): n.chars - n.linked for n in self.nodes}
        rest = self.root.chars - self.root.linked
        for n in reversed(self.nodes):
            if n.skip and not n.wrapper:
                continue
            if n.parent is self.root:
                rest += held[id(n)]
            else:
                held[id(n.parent)] += held[id(n)]
        for n in self.nodes:
            if n.wrapper and n.skip and held[id(n)] >= max(PROSE_CHARS, WRAPPED * rest):
                n.skip = n.soft = False

    def settle(self, kept: frozenset[int], dropped: frozenset[int]) -> list[Node]:
        """Decides on wrappers and weakly named blocks and gives the scored containers, in page order: text outside links, in paragraphs above all."""
        self.unwrap()
        for n in reversed(self.nodes):
            if n.tag in PARAGRAPHS:
                n.para = max(n.para, n.chars - n.linked)
            if n.weak and not n.skip:
                n.skip = n.key in dropped or (n.key not in kept and not prose(n))
            if n.tag in CONTAINERS:
                n.score = (n.chars - 2 * n.linked + 2 * n.para) * (1.5 if n.tag in ("article", "main") else 1.2 if n.words & KEEP_WORDS else 1.0)
            if not n.skip:
                up = n.parent
                up.chars += n.chars
                up.linked += n.linked
                up.para += n.para
        for n in self.nodes:  # a container within something left out stands for nothing
            if n.parent.skip:
                n.skip = True
        return [n for n in self.nodes if not n.skip and n.tag in CONTAINERS]

    def blocks(self, node: Node) -> list[str]:
        """Texts of an element's blocks, skipped parts left out."""
        out: list[str] = []
        line: list[str] = []

        def flush() -> None:
            if line:
                joined = SPACE.sub(" ", entities.unescape("".join(line))).strip()
                line.clear()
                if joined:
                    out.append(joined)

        events, todo = self.events, [(node.start + 1, node.stop)]
        while todo:
            at, stop = todo.pop()
            while at < stop:
                e = events[at]
                at += 1
                if isinstance(e, str):
                    line.append(e)
                elif e.tag == "br":
                    line.append(" ")
                else:
                    if e.tag in BLOCK:
                        flush()
                    if e.start == at - 1 and e.stop > e.start:
                        if e.skip:
                            at = e.stop + 1
                        elif e.tag == "header":  # its headings alone
                            todo.append((e.stop, stop))
                            heads = [h for h in events[at : e.stop] if isinstance(h, Node) and h.parent is e and (h.tag in HEADINGS or h.tag == "hgroup") and h.stop > h.start]
                            todo += [(h.start, h.stop + 1) for h in dict.fromkeys(reversed(heads))]
                            break
        flush()
        return out


def prose(n: Node) -> bool:
    return n.chars - n.linked >= PROSE_CHARS and n.linked <= PROSE_LINKS * n.chars


def best(found: list[Node], root: Node) -> Node:
    """The highest score; of containers near it the innermost, articles first."""
    if not found:
        return root
    top = max(n.score for n in found)
    return max((n for n in found if n.score >= 0.98 * top), key=lambda n: (n.tag == "article", n.tag == "main", n.depth))


def signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def vote(source: str | None) -> list[tuple[bool, int, float, int]]:
    """(vote or weakly named block, path, score or whether it is prose, hash of the block's text)."""
    page = Page(source or "")
    node = best(page.settle(NOTHING, NOTHING), page.root)
    out = [(True, signed(node.key), max(node.score, 0.0), 0)]
    out += [(False, signed(n.key), float(prose(n)), signed(xxhash.xxh64_intdigest("\n".join(page.blocks(n))))) for n in page.nodes if n.weak]
    return out


def extract(source: str | None, winner: int | None, kept: frozenset[int] = NOTHING, dropped: frozenset[int] = NOTHING) -> tuple[str, str]:
    """Text and the path it comes from; the host's winning path and what it decided on weakly named blocks are hashes."""
    page = Page(source or "")
    found = page.settle(kept, dropped)
    node = best(found, page.root)
    if winner is not None:
        on_path = [n for n in found if n.key == winner]  # they can't nest: paths would differ
        if on_path and sum(n.score for n in on_path) >= MIN_OF_BEST * node.score:
            return "\n\n".join(b for n in on_path for b in page.blocks(n)), path_of(on_path[0])
    return "\n\n".join(page.blocks(node)), path_of(node)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


@contextmanager
def uncollected() -> Iterator[None]:
    """A page's elements form no cycles; looking for some among millions takes longer than all else."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, got = [], []
        for h, source in zip(batch.column(0), batch.column(1)):
            with uncollected():
                rows = vote(source.as_py())
            hosts += [h.as_py()] * len(rows)
            got += rows
        vote_, path, score, text = zip(*got) if got else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(vote_, pa.bool_()), pa.array(path, pa.int64()), pa.array(score, pa.float64()), pa.array(text, pa.int64())], names=["host", "vote", "path", "score", "text"])


def winners(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, winner, kept, dropped): the path that most of a host's pages vote for, null if none has enough, and the paths of weakly named blocks that are article there or aren't."""
    cast = pages.select(host(F.col(url)).alias("host"), F.col(source).alias("html")).mapInArrow(_votes, "host string, vote boolean, path bigint, score double, text bigint")
    # both kinds are summed by host, path and text first: votes have one text, 0
    sums = cast.filter("NOT vote OR score > 0").groupBy("host", "vote", "path", "text").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("vote"), F.log1p("score")).otherwise(F.col("score"))).alias("weight"))
    by_path = sums.groupBy("host", "vote", "path").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"), F.sum("weight").alias("weight"))
    article = (F.col("texts") >= OWN_SHARE * F.col("n")) & (F.col("weight") >= OWN_SHARE * F.col("n"))
    seen = ~F.col("vote") & (F.col("n") >= MIN_SEEN)
    told = by_path.groupBy("host").agg(
        F.sum(F.when(F.col("vote"), F.col("n"))).alias("pages"),
        F.max(F.when(F.col("vote"), F.struct("n", F.round("weight", 3).alias("weight"), "path"))).alias("b"),
        F.collect_list(F.when(seen & article, F.col("path"))).alias("kept"),
        F.collect_list(F.when(seen & ~article, F.col("path"))).alias("dropped"),
    )
    enough = (F.col("b.n") >= MIN_VOTES) & (F.col("b.n") >= MIN_SHARE * F.col("pages"))
    won = told.select("host", F.when(enough, F.col("b.path")).alias("winner"), "kept", "dropped")
    return won.filter("winner IS NOT NULL OR size(kept) > 0 OR size(dropped) > 0")


def _extract(batches: Iterator[pa.RecordBatch], *, out: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    unsigned = lambda x: x & 0xFFFFFFFFFFFFFFFF
    for batch in batches:
        n = batch.num_columns
        got = []
        for source, winner, kept, dropped in zip(*(batch.column(i) for i in range(n - 4, n))):
            w = winner.as_py()
            sets = [frozenset(map(unsigned, x.as_py() or ())) for x in (kept, dropped)]
            with uncollected():
                got.append(extract(source.as_py(), None if w is None else unsigned(w), *sets))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-4], pa.array([t for t, _ in got], pa.string()), pa.array([p for _, p in got], pa.string())], names=[*batch.schema.names[:-4], *out])


def main_text(pages: DataFrame, url: str = "url", source: str = "html", keep: list[str] | None = None, out: tuple[str, str] = ("text", "text_path")) -> DataFrame:
    """The columns `keep` (default: all but the html), the main text and the container's path.

    The table of winners, a row a host, is stored and measured: small, it is
    broadcast; else pages are joined to it by host, which adaptive execution
    splits where one host fills a partition.
    """
    keep = [c for c in (keep or [c for c in pages.columns if c != source]) if c not in out]
    won = stored(winners(pages, url, source), "html-winners")
    size = won.agg(F.sum(F.octet_length("host") + 8 * (F.size("kept") + F.size("dropped")) + 96).alias("b")).first()
    if (size["b"] or 0) <= BROADCAST_LIMIT_BYTES:
        won = F.broadcast(won)
    h, k, w, x, y = fresh(pages, "_html", "_host", "_winner", "_kept", "_dropped")
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(source).alias(h), host(F.col(url)).alias(k))
    joined = rows.join(won.withColumnsRenamed({"host": k, "winner": w, "kept": x, "dropped": y}), k, "left").select(*[F.col(f"`{c}`") for c in keep], h, w, x, y)
    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField(out[0], T.StringType()), T.StructField(out[1], T.StringType())])
    return joined.mapInArrow(partial(_extract, out=out), schema)
