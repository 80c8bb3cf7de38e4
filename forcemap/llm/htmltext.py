"""Main text of web pages by removing what a site repeats.

Every element's subtree (tags, classes and text, not links) is hashed. Spark counts, per host, the different pages that
hold each hash: rows with the same html are one page, so copies of a page don't make its text a template. A subtree that recurs on many pages of its host is template and is deleted; what is left is text. Elements that
are never main text by their kind (menus, headers, footers, asides, forms, scripts, adverts, comments) go too, by tag, role
or a word in a class or id. Words that also name parts of an article (``header``, ``share``, ``menu``) only count outside of
articles and on containers; inside one, such an element goes if it recurs. Where a page marks its article, only the article
counts, and a plain paragraph or heading in it without such a word is never taken for template: sites do publish the same
paragraph often, and dropping it would lose text.

Recurring: on at least ``LEAST_PAGES`` different pages and ``LEAST_SHARE`` of the host's different pages. The share bounds the templates of a
host to the subtrees of a page divided by it, whatever the host's size.

Defined results: null html is empty and gives empty text; a null or odd url has the empty host, whose pages are counted
like those of any other; ids may be null or repeat; broken markup is closed where a browser would roughly close
it; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forcemap.session import staged

LEAST_PAGES = 5
LEAST_SHARE = 0.1

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select".split())
NEVER = RAW | frozenset("head nav header footer aside form button menu dialog canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr table tbody thead figcaption caption ul ol dl".split())
#: A start tag of the key ends an open element of these kinds, up to the nearest of the bounds.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())
#: Words in a class or id that name parts which are never main text,
HARD_WORDS = "ad ads advert advertisement adbox sponsor sponsored navbar breadcrumb breadcrumbs sidebar side-bar cookie cookies consent popup modal newsletter subscribe comment comments disqus reply replies respond pagination pager"
#: and words that often do, but also name parts of an article: inside one, counting has to agree.
SOFT_WORDS = "banner promo nav navigation menu footer header masthead notice share sharing social related widget skip toolbar"
HARD, SOFT = (re.compile(rf"(?:^|[\s_-])(?:{'|'.join(words.split())})(?:$|[\s_-])", re.I) for words in (HARD_WORDS, SOFT_WORDS))
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: What decides where a tag ends: its end, or a value's beginning.
NEXT = re.compile(r"[>=]")
SPACE, BARE = re.compile(r"\s*"), re.compile(r"[^\s>]*")
ATTRIBUTE = re.compile(r"""([^\s=/"'][^\s=/]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'][^\s]*)?))?""")
#: Headings, paragraphs and inline elements aren't dropped for a soft word alone.
OWN = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt".split())


class Node:
    """``part`` says by its kind: 0 may be main text, 1 only if it doesn't recur (or isn't in an article), 2 never."""

    __slots__ = ("tag", "mark", "part", "kids", "hash")

    def __init__(self, tag: str, mark: str = "", part: int = 0) -> None:
        self.tag, self.mark, self.part, self.kids, self.hash = tag, mark, part, [], None


def _marked(tag: str, attributes: str) -> tuple[str, int]:
    """What a node's hash takes from its attributes, and its ``part``."""
    part = 2 if tag in NEVER else 0
    if not attributes or attributes.isspace():
        return "", part
    marks = []
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip()
        if name not in ("class", "id", "role", "hidden", "aria-hidden"):
            continue
        marks.append(f"{name}={value}")
        if name in ("class", "id"):
            part = max(part, 2 if HARD.search(value) else 1 if SOFT.search(value) else 0)
        elif name == "hidden" or name == "role" and value in ROLES or name == "aria-hidden" and value == "true":
            part = 2
    return " ".join(marks), part


class _Tags:
    """Finds tags by the rules for attributes: quotes only count where a value begins. Every search is made once."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, {c: page.rfind(c) for c in ">\"'"}
        self.no_end: set[str] = set()

    def end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` has its ``>``; -1 if nowhere."""
        page, last = self.page, self.last
        start = at
        while m := NEXT.search(page, at):
            if m[0] == ">":
                return m.start()
            at = SPACE.match(page, m.end()).end()
            quote = page[at : at + 1]
            if quote not in ("'", '"') or not quote:
                at = BARE.match(page, at).end()
            elif at < last[quote]:
                at = page.index(quote, at + 1) + 1
            else:
                return page.find(">", start)  # a quote that never ends
        return -1

    def raw_end(self, tag: str, at: int) -> int:
        """Behind the end tag of the raw element; -1 if there is none."""
        if tag in self.no_end:
            return -1
        if found := re.compile(rf"</{tag}\s*>", re.I).search(self.page, at):
            return found.end()
        self.no_end.add(tag)
        return -1

    def at(self, at: int) -> tuple[int, str, str, str] | None:
        """(behind, slash, name, attributes) of the markup at a ``<``, name empty for comments; None for a lone character."""
        page = self.page
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4) if "--" not in self.no_end else -1
            if stop < 0:
                self.no_end.add("--")
            return (len(page) if stop < 0 else stop + 3), "", "", ""
        if at > self.last[">"]:
            return None
        if page[at + 1 : at + 2] in ("!", "?"):
            return page.index(">", at) + 1, "", "", ""
        m = NAME.match(page, at + 1)
        if not m:
            return None
        stop = self.end(m.end())
        return None if stop < 0 else (stop + 1, m[1], m[2].lower(), page[m.end() : stop])


def parse(page: str) -> Node:
    """A tree of nodes and strings; strings still hold character references. Elements nest to any depth."""
    root = Node("html")
    open_nodes, at, size, tags = [root], 0, len(page), _Tags(page)
    places: dict[str, list[int]] = {}  # per tag, where it is open; so nesting costs no search
    blocks = [0]  # where blocks but paragraphs are open

    def innermost(kinds) -> int:
        return max((own[-1] for t in kinds if (own := places.get(t))), default=0)

    def end_at(i: int) -> None:
        for gone in reversed(open_nodes[i:]):
            places[gone.tag].pop()
            if gone.tag in BLOCKS and gone.tag != "p":
                blocks.pop()
        del open_nodes[i:]

    while at < size:
        end = page.find("<", at)
        while end >= 0 and not (found := tags.at(end)):
            end = page.find("<", end + 1)  # a lone character
        if end < 0:
            open_nodes[-1].kids.append(page[at:])
            break
        if end > at:
            open_nodes[-1].kids.append(page[at:end])
        at, slash, tag, attributes = found
        if not tag:
            continue
        if slash:
            i = innermost((tag,))
            if i and (tag in BLOCKS or i > blocks[-1]):  # an inline end tag doesn't close a block
                end_at(i)
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCKS and (i := innermost(("p",))) > blocks[-1]:  # a block ends an open paragraph
            end_at(i)
        if tag in ENDS:
            ends, bounds = ENDS[tag]
            if (i := innermost(ends)) > innermost(bounds):
                end_at(i)
        node = Node(tag, *_marked(tag, attributes))
        open_nodes[-1].kids.append(node)
        if tag in RAW:
            close = tags.raw_end(tag, at)
            at = close if close >= 0 else (size if tag in ("script", "style", "textarea", "title") else at)
        elif tag not in VOID and not attributes.endswith("/"):
            places.setdefault(tag, []).append(len(open_nodes))
            if tag in BLOCKS and tag != "p":
                blocks.append(len(open_nodes))
            open_nodes.append(node)
    return root


def _squeezed(text: str) -> str:
    return " ".join((entities.unescape(text) if "&" in text else text).split())


def _hashed(root: Node) -> int:
    import xxhash

    order = [root]
    for node in order:
        order += [k for k in node.kids if isinstance(k, Node)]
    for node in reversed(order):  # children before their parents
        parts = [node.tag, node.mark]
        for k in node.kids:
            if isinstance(k, str):
                if t := k.strip():
                    parts.append("t" + t)
            else:
                parts.append("n%x" % k.hash)
        node.hash = xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)
    return root.hash


def _never(node: Node, article: bool = False) -> bool:
    """Left out by its kind alone; in an article, and for headings, paragraphs and inline elements, a soft word isn't enough."""
    return node.part == 2 or node.part == 1 and not article and node.tag in BLOCKS and node.tag not in OWN


def _articles(node: Node, tag: str) -> list[Node]:
    """Outermost elements of the kind, outside of what never is main text."""
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        for k in reversed(n.kids):
            if isinstance(k, Node) and not (k.tag != tag and _never(k)):
                stack.append(k)
        if n.tag == tag and n is not node:
            out.append(n)
            del stack[len(stack) - sum(isinstance(k, Node) and not (k.tag != tag and _never(k)) for k in n.kids) :]
    return out


def _candidates(root: Node) -> set[int]:
    """Hashes of all subtrees that hold text and aren't left out by their kind."""
    _hashed(root)
    found, stack = set(), [k for k in root.kids if isinstance(k, Node)]
    while stack:
        n = stack.pop()
        if _never(n, True):
            continue
        if n.kids:
            found.add(n.hash)
        stack.extend(k for k in n.kids if isinstance(k, Node))
    return found


def main_text(root: Node, templates: set[int] | frozenset[int] = frozenset()) -> str:
    """Blocks of the main text, joined by line ends; ``root`` needs hashes where there are templates."""
    tops = _articles(root, "article") or _articles(root, "main")
    blocks, line = [], []

    def flush() -> None:
        if text := _squeezed("".join(line)):
            blocks.append(text)
        line.clear()

    def walk(top: Node, plain: bool) -> None:
        stack = [(iter(top.kids), True)]  # and whether a line ends behind
        while stack:
            kids, ends = stack[-1]
            for k in kids:
                if isinstance(k, str):
                    line.append(k)
                    continue
                if k.tag in ("br", "wbr", "img"):
                    line.append(" " if k.tag == "br" else "")
                    continue
                guarded = (plain and k.tag in PLAIN or k.tag not in BLOCKS) and not k.part
                if _never(k, plain) or k.hash in templates and not guarded:
                    continue
                if k.tag in BLOCKS:
                    flush()
                stack.append((iter(k.kids), k.tag in BLOCKS))
                break
            else:
                stack.pop()
                if ends:
                    flush()

    for top in tops or [root]:
        walk(top, bool(tops))
    return "\n".join(blocks)


def host_of(url_col: str):
    u = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(u, r"^(?s:.*?)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def recurring(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, templates): hashes of the subtrees that recur on many different pages of the host; pages have host and html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        # Copies of a page within the batch are parsed once; hash zero counts pages.
        for batch in batches:
            found: dict[tuple[str, bytes], list[int]] = {}
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                key = host, xxhash.xxh3_128_digest(page.encode("utf-8", "surrogatepass"))
                if key not in found:
                    found[key] = [*_candidates(parse(page)), 0]
            hosts, digests = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.binary()), pa.array(list(found.values()), pa.list_(pa.int64()))], ["host", "page", "hashes"])

    # Only digests and hashes move; equal pages of a host have equal hashes.
    distinct = pages.select("host", "html").mapInArrow(run, "host string, page binary, hashes array<long>").dropDuplicates(["host", "page"])
    seen = distinct.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    often = seen.filter(F.col("n") >= least_pages)
    totals = often.filter("hash = 0").select("host", F.col("n").alias("pages"))
    return often.filter("hash <> 0").join(totals, "host").filter(F.col("n") >= least_share * F.col("pages")).groupBy("host").agg(F.collect_list("hash").alias("templates"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), host_of(url_col).alias("host")
    )
    # One row per host with a list bounded by the share, written out: the join then has plain exchanges on both sides,
    # and adaptive execution splits a host with very many pages.
    joined = rows.join(staged(recurring(rows, least_pages, least_share), "templates"), "host", "left").select("page_id", "url", "html", "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, templates in zip(batch.column("html").to_pylist(), batch.column("templates").to_pylist(), strict=True):
                root = parse(page)
                if templates:
                    _hashed(root)
                texts.append(main_text(root, frozenset(templates or ())))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
