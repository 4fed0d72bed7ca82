"""HTML extraction with a site style tree.

Pages are parsed once into text blocks, each on a branch: the path of elements (with class and id) that leads to it. The
DOMs of a host are merged by branch, and each branch gets an importance between 0 and 1 from entropies over the host's m
pages, in logarithms to the base m:

* presentation: the entropy of the child sequences that the block's parent shows; a parent that always looks alike has 0;
* content: 1 less the mean entropy of the branch's texts over pages; a text that is on every page adds 0, one that is on
  one page only adds 1.

The composite is GAMMA * content + (1 - GAMMA) * presentation. An inner node's takes for content the mean of the branches of its
subtree, by their pages. Branches of low importance are removed from each page; an inner node goes with its whole subtree,
rare branches too, if its importance and those of all its frequent branches are low. A text that nearly all pages with its
branch show goes as well: a promo paragraph shares its branch with the page's own ones.
What HTML itself says is a prior: landmarks and names of menus, headers, footers, sidebars, notices, adverts, forms and comments
have importance 0, and where a page has article or main regions, only blocks in them are candidates. The entropies decide about
all candidates, inside such regions too, on hosts with enough pages.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

GAMMA = 0.9
#: Branches under this importance are removed where they are on so many pages of the host at least.
LEAST_IMPORTANCE, LEAST_PAGES = 0.3, 4
#: A text is removed where it is on this share of the pages that have its branch.
COMMON = 0.9
#: So many elements above a block's own can take it away with their subtree.
ABOVE = 8

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_OPEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)([^<>]*+)>?")  # a quote that doesn't close, or another tag before the end
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Elements whose content is never text of the page.
_RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "svg", "math", "object", "xmp", "noembed", "noframes", "canvas", "audio", "video"}
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}
_ITEMS = {"li", "dt", "dd", "td", "th", "tr", "option"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture br nobr".split())
_NOISE_TAGS = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset", "head", "datalist", "label"}
_NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tablist"}
_NOISE = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|adslot|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|signup|sign-up|login|"
    r"nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|side|aside|widget\w*|footer|foot|masthead|topbar|header|comments?|commentlist|comment-\w+|replies|reply|respond|disqus|"
    r"related|recommend\w*|share|sharing|social|toolbar|pagination|pager|skip-?link|search|copyright|legal|disclaimer|tags?|outbrain|taboola)(?:$|[-_\s\d])", re.I)
_MAIN = re.compile(r"(?:^|[-_\s])(?:article|article-?body|post-?body|post-?content|entry-?content|main-?content|story-?body|articletext|content-?main|post|entry|story)(?:$|[-_\s])", re.I)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
NOISE, OPEN, MAIN = 0, 1, 2


def _hash(text: str, above: int = 0) -> int:
    """A hash of a text, or of a step below a branch."""
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), above & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _state(tag: str, attrs: str, above: int) -> tuple[int, str]:
    """What an element makes of its content, and its step on the branch."""
    said = {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(attrs)} if attrs.strip(" /\t\r\n") else {}
    names = f"{said.get('class', '')} {said.get('id', '')}".strip()
    step = f"{tag}.{re.sub(r'[0-9]+', '#', names)}" if names else tag
    role = said.get("role", "").lower()
    if tag in ("article", "main") or role in ("main", "article") or tag == "body":
        # a page's text starts here even in a menu that was never closed; teasers and comments in article elements aren't it
        if tag != "body" and _NOISE.search(names):
            return NOISE, step
        return (OPEN if tag == "body" else MAIN), step
    if above == NOISE:
        return NOISE, step
    if tag in _NOISE_TAGS or role in _NOISE_ROLES or "hidden" in said or said.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", said.get("style", "")):
        return NOISE, step
    if tag == "header" and above != MAIN:
        return NOISE, step
    if names and tag != "html":
        if _MAIN.search(names) and not _NOISE.search(names):
            return MAIN, step
        if _NOISE.search(names) and not (tag in _HEADINGS or tag == "header" and above == MAIN):
            return NOISE, step
    return above, step


class _Element:
    """An open element: its block (the nearest element that isn't inline, itself included), and its branch's hash."""

    __slots__ = ("tag", "state", "least", "branch", "block", "children", "above")

    def __init__(self, tag: str, state: int, branch: int, parent: _Element | None, inline: bool):
        self.tag, self.state, self.branch, self.children, self.above = tag, state, branch, [], parent
        self.block = parent.block if inline else self
        self.least = min(state, parent.least) if inline else state  # over the inline elements of the block


def _tokens(page: str):
    """(text before, end tag or not, tag, attributes, where it ends) in order; tag is empty at comments and the end. Each character
    is looked at a few times, whatever isn't closed."""
    at, seen, n = 0, 0, len(page)
    while True:
        lt = page.find("<", seen)
        if lt < 0:
            yield page[at:], False, "", "", n
            return
        if page.startswith("<!--", lt):
            end, size = page.find("-->", lt + 4), 3
        elif page.startswith("<![CDATA[", lt):
            end, size = page.find("]]>", lt), 3
        elif page.startswith(("<!", "<?"), lt):
            end, size = page.find(">", lt), 1
        else:
            m = _TAG.match(page, lt) or _OPEN_TAG.match(page, lt)
            if m is None:
                seen = lt + 1  # a bare sign
                continue
            at = seen = (yield page[at:lt], bool(m[1]), m[2].lower(), m[3], m.end())
            continue
        end = n if end < 0 else end + size
        yield page[at:lt], False, "", "", end
        at = seen = end


def parse(page: str) -> tuple[list[tuple[int, int, str, tuple[int, ...]]], list[tuple[int, int]]]:
    """Text blocks of a page in order, as (state, branch, text, branches above), and the child sequences of their parents, as
    (branch, sequence). Time and memory are linear in the page, whatever is nested or left open."""
    blocks: list[tuple[int, int, str, tuple[int, ...]]] = []
    root = _Element("", OPEN, 0, None, False)
    stack, count, links = [root], Counter(), 0
    styles: dict[int, int] = {}
    text: list[str] = []
    linked = [0, 0]  # characters in links, characters
    unclosed: set[str] = set()

    def flush() -> None:
        joined = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if joined:
            top = stack[-1]
            inner = top.least
            if inner == OPEN and linked[1] and linked[0] >= 0.9 * linked[1]:
                inner = NOISE  # links and nothing else
            above, e = [], top.block.above
            while e is not None and len(above) < ABOVE:
                if e.block is e:
                    above.append(e.branch)
                e = e.block.above if e.block is not e else e.above
            blocks.append((inner, top.block.branch, joined, tuple(above)))
        linked[:] = [0, 0]

    def close(tag: str) -> None:
        """Close the nearest open element of a tag, and what is open in it."""
        nonlocal links
        while True:
            e = stack.pop()
            count[e.tag] -= 1
            links -= e.tag == "a"
            if e.children and e.block is e:
                styles[e.branch] = _hash(" ".join(e.children))
            if e.tag == tag:
                return

    tokens = _tokens(page)
    token = next(tokens)
    while True:
        piece, is_end, tag, attrs, at = token
        if piece:
            text.append(piece)
            size = len(piece.strip())
            linked[1] += size
            if links:
                linked[0] += size
        if not tag:
            token = next(tokens, None)
            if token is None:
                break
            continue
        if is_end:
            if count[tag]:
                state = stack[-1].state
                if tag not in _INLINE or stack[-1].tag != tag or state != stack[-1].above.state:
                    flush()
                close(tag)
            elif tag not in _INLINE:
                flush()
        elif tag in _RAW:
            text.append(" ")
            end = None if tag in unclosed else _END[tag].search(page, at)
            if end is not None:
                at = end.end()
            elif tag in ("noscript", "object", "iframe"):
                unclosed.add(tag)  # its content is read as the page's
            else:
                at = len(page)
        elif tag in _VOID:
            if tag == "hr":
                flush()
            else:
                text.append(" " if tag == "br" else "")
        else:
            inline = tag in _INLINE
            if not inline:
                flush()
                # an open paragraph, item or cell ends where the next one begins
                over = stack[-1].block
                if over.tag == "p" or over.tag == tag and tag in _ITEMS:
                    close(over.tag)
            parent = stack[-1]
            state, step = _state(tag, attrs, parent.state)
            if inline and state != parent.state:
                flush()
            if not inline and (not parent.children or parent.children[-1] != step):
                parent.children.append(step)
            if not attrs.endswith("/"):
                stack.append(_Element(tag, state, parent.branch if inline else _hash(step, parent.branch), parent, inline))
                count[tag] += 1
                links += tag == "a"
        token = tokens.send(at)
    flush()
    while len(stack) > 1:
        close(stack[-1].tag)
    return blocks, list(styles.items())


def host_of(url: str) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url)
    return m[1].lower() if m else ""


_BLOCK = pa.struct([("branch", pa.int64()), ("feature", pa.int64()), ("text", pa.string())])
_MARK = pa.struct([("branch", pa.int64()), ("feature", pa.int64())])
_ABOVE = pa.struct([("branch", pa.int64()), ("above", pa.list_(pa.int64()))])
_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("blocks", pa.list_(_BLOCK)), ("texts", pa.list_(_MARK)), ("styles", pa.list_(_MARK)), ("above", pa.list_(_ABOVE))])


def _parsed(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            out = {f.name: [] for f in _PARSED}
            for page, url, source in zip(*(batch.column(i).slice(a, 256).to_pylist() for i in range(3))):
                blocks, styles = parse(source or "")
                main = any(s == MAIN for s, *_ in blocks)
                marked = [(s, b, _hash(t), t) for s, b, t, _ in blocks]
                kept = [{"branch": b, "feature": f, "text": t} for s, b, f, t in marked if s == (MAIN if main else OPEN)]
                row = (page, url, host_of(url or ""), kept, [{"branch": b, "feature": f} for b, f in {(b, f) for _, b, f, _ in marked}],
                       [{"branch": b, "feature": f} for b, f in styles], [{"branch": b, "above": a} for b, a in {b: a for _, b, _, a in blocks}.items()])
                for col, v in zip(out.values(), row):
                    col.append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_PARSED)


def _counts(parsed: DataFrame, marks: str) -> DataFrame:
    """(host, branch, feature, k): feature f is on k pages."""
    return parsed.select("host", F.explode(marks).alias("m")).groupBy("host", "m.branch", "m.feature").agg(F.count("*").alias("k"))


def _entropies(each: DataFrame) -> DataFrame:
    """(host, branch): pages and the sums over features f on k_f pages that both entropies are made of."""
    return each.groupBy("host", "branch").agg(F.count("*").alias("kinds"), F.sum(F.ln("k")).alias("logs"), F.sum("k").alias("n"), F.sum(F.col("k") * F.ln("k")).alias("klogs"))


def style_tree(parsed: DataFrame) -> DataFrame:
    """(host, branch, n_pages, importance, whole, common) of the branches of every host's merged tree that lead to text. whole: the
    branch goes, by its own importance or with an inner node; common: texts of nearly all its pages."""
    marks = parsed.select("host", F.explode("above").alias("m")).select("host", "m.branch", "m.above")
    # a branch is a path, so its pages agree about what is above it
    pages = marks.groupBy("host", "branch").agg(F.count("*").alias("n_pages"), F.first("above").alias("above"))
    base = F.ln(F.greatest(F.lit(2), F.col("n_pages")))
    texts = _counts(parsed, "texts")
    content = _entropies(texts).select("host", "branch", "kinds", "logs")
    look = _entropies(_counts(parsed, "styles")).select("host", "branch", F.col("n").alias("shown"), (F.ln("n") - F.col("klogs") / F.col("n")).alias("entropy"))
    # at most a page's number of blocks, over COMMON, for each branch
    often = texts.where(F.col("k") >= COMMON * LEAST_PAGES).join(pages.select("host", "branch", "n_pages"), ["host", "branch"]).where(F.col("k") >= COMMON * F.col("n_pages"))
    often = often.groupBy("host", "branch").agg(F.collect_list("feature").alias("common"))
    both = pages.join(content, ["host", "branch"]).join(look, ["host", "branch"], "left").join(often, ["host", "branch"], "left")
    by_content = F.greatest(F.lit(0.0), 1 - F.col("logs") / (F.col("kinds") * base))
    by_look = F.least(F.lit(1.0), F.coalesce("entropy", F.lit(0.0)) / base)
    value = F.when(F.col("n_pages") == 1, 1.0).otherwise(GAMMA * by_content + (1 - GAMMA) * by_look)
    leaves = both.select("host", "branch", "n_pages", "above", value.alias("importance"), F.coalesce("common", F.array().cast("array<bigint>")).alias("common"))
    leaves = stored(leaves.withColumn("frequent", F.col("n_pages") >= LEAST_PAGES).withColumn("low", F.col("frequent") & (F.col("importance") < LEAST_IMPORTANCE)), "leaves")
    # inner nodes: the subtree's mean by pages, and whether all its frequent branches are low; a row for each host and path
    below = leaves.select("host", F.explode("above").alias("node"), "branch", "n_pages", "importance", "frequent", "low")
    inner = below.groupBy("host", "node").agg(
        (F.sum(F.col("n_pages") * F.col("importance")) / F.sum("n_pages")).alias("mean"), F.min(F.col("low") | ~F.col("frequent")).alias("all_low"), F.max("n_pages").alias("most"))
    inner = inner.join(look.withColumnRenamed("branch", "node"), ["host", "node"], "left")
    look_of = F.least(F.lit(1.0), F.coalesce(F.col("entropy") / F.ln(F.greatest(F.lit(2), F.col("shown"))), F.lit(0.0)))
    noisy = inner.where(F.col("all_low") & (F.col("most") >= LEAST_PAGES) & (GAMMA * F.col("mean") + (1 - GAMMA) * look_of < LEAST_IMPORTANCE))
    under = below.join(noisy.select("host", "node"), ["host", "node"], "left_semi").select("host", "branch").distinct().withColumn("under", F.lit(True))
    return leaves.join(under, ["host", "branch"], "left").select(
        "host", "branch", "n_pages", "importance", (F.col("low") | F.coalesce("under", F.lit(False))).alias("whole"),
        F.when(F.col("frequent"), F.col("common")).otherwise(F.array().cast("array<bigint>")).alias("common"))


def main_text(pages: DataFrame) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars.

    A null or empty html, or a page of nothing but menus and the like, has an empty text. Pages of which every candidate
    block would go keep them all, as a host of equal pages would else be emptied. Null urls count as one host. Repeated
    rows each give a row; no rows give none; columns besides page_id, url and html are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    marks = "array<struct<branch: bigint, feature: bigint>>"
    parsed = rows.mapInArrow(_parsed, f"page_id long, url string, host string, blocks array<struct<branch: bigint, feature: bigint, text: string>>, texts {marks}, styles {marks}, above array<struct<branch: bigint, above: array<bigint>>>")
    parsed = stored(parsed.withColumn("row", F.monotonically_increasing_id()), "pages")
    low = stored(style_tree(parsed).where(F.col("whole") | (F.size("common") > 0)).select("host", "branch", "whole", "common"), "low")  # a scan: the join on a large host's branches can be split
    asked = parsed.select("row", "host", F.explode(F.array_distinct(F.transform("blocks", lambda b: b["branch"]))).alias("branch"))
    removed = asked.join(low, ["host", "branch"]).groupBy("row").agg(F.collect_list(F.struct("branch", "whole", "common")).alias("gone"))
    removed = stored(removed, "gone")  # few pages or many: its size decides how it is joined
    kept = F.filter("blocks", lambda b: ~F.exists("gone", lambda g: (g["branch"] == b["branch"]) & (g["whole"] | F.array_contains(g["common"], b["feature"]))))
    out = parsed.select("row", "page_id", "url", "blocks").join(removed, "row", "left").withColumn("left", F.when(F.col("gone").isNotNull(), kept))
    chosen = F.when(F.size("left") > 0, F.col("left")).otherwise(F.col("blocks"))
    out = out.select("page_id", "url", F.array_join(F.transform(chosen, lambda b: b["text"]), "\n").alias("text"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
