"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its containers (by the tags, classes and ids on their path; the page itself is the
outermost) and its text blocks in their container. Over the distinct pages of one host, tokens with equal
occurrence vectors (how often a token stands on each page; compared by a digest that Spark sums up, so no host
is gathered in one place) form an equivalence class. A member is valid if it has the same place in the order of
its class on every page. The valid containers of the classes, nested by their paths, are the host's template;
what stands in one of them and in none below it fills its slot.

The slots decide what the page's own text is: from the page inwards, the template's container that holds most of
the unlinked text is entered as long as it holds SHARE of it; names of tags and classes only weigh less what
they call a menu, advert, comment ... The last one is the host's main slot. Of its content are left out: the
template's containers made of links, containers (of the template or not) named as something else, and template
text: text inside a container of its own class, unless the pages that have it are copies of one another (their
main slots hold mostly text that half of the host's pages have). So text that merely repeats stays. Where no slot
prevails and the page has an article there, that is taken. A page
without its host's main slot, and a page of a host with too few pages, is judged by itself: its article, or all
but the containers named as something else and blocks of links. A name says so only if all its words do; an article's
own name gives way to its having most text; and a page with visible unlinked text never comes out empty because of
names: then the container with most of it is taken, whatever it is called.

Pages of a host whose own text is the same count as one page, whatever stands around it. A host's template holds
only tokens that stand on at least SUPPORT of its pages, so its size is bounded by the average number of tokens
of its pages / SUPPORT.

Defined results: null html counts as empty and gives ''; a page without a usable url belongs to the host ''
and has no template; cut-off markup at the end is dropped; very long pages and unclosed markup are read in
linear time; of containers with equally much text the first by its token is entered; repeated rows give equal
results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegrid.llm.common import map_text, materialize
from notegrid.storage import Workspace

SUPPORT, LEAST_PAGES = 0.5, 5
#: A container is entered if it holds this share of the text; the weight of one that is named as something else.
SHARE, NAMED = 0.6, 0.25

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: Attributes up to the end of a tag; quotes count after an equals sign only.
REST = re.compile(r"(?:[^>=]|=(?!\s*[\"'])|=\s*\"[^\"]*\"|=\s*'[^']*')*+>")
CUT = re.compile(r"<[a-zA-Z/!][^<>]*\Z")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
RAW = {"script": re.compile(r"</script", re.I), "style": re.compile(r"</style", re.I), "textarea": re.compile(r"</textarea", re.I), "title": re.compile(r"</title", re.I), "noscript": re.compile(r"</noscript", re.I), "template": re.compile(r"</template", re.I), "iframe": re.compile(r"</iframe", re.I), "svg": re.compile(r"</svg", re.I)}
CONTAINERS = frozenset("html head body main article section nav aside header footer div form ul ol dl table tbody thead tr td th fieldset figure details dialog menu center button select label".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd br hr pre blockquote address figcaption caption option summary".split())
DROPPED_TAGS = frozenset("head nav aside header footer form button select dialog menu fieldset".split())
#: Words in a class, id or role that name something else than the article.
DROPPED_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments reply replies consent cookie cookies disqus footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion related respond rail search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar widget widgets navigation complementary contentinfo alert dialog login skip".split())
#: Words that may stand beside one of those in a name (comment-list, site-footer); beside any other word (ad-free, has-sidebar) it names nothing.
BESIDE_WORDS = frozenset("area bar block body bottom box button card col column container content feed global group header icon inner item items layer left link links list main outer page panel post posts primary right row secondary section site slot space stories story strip text thread title top unit wrap wrapper".split())
WORDS = re.compile(r"[a-z]+")
HEADING = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])


def label_of(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Role of a container (tag, class and id without digits), whether its tag or state leaves it out, and whether its name says so."""
    dropped = tag in DROPPED_TAGS
    if not attributes.strip():
        return tag, dropped, False
    role, named = tag, False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            role += "." + re.sub(r"[\d/]+", "", value)
            if tag not in ("html", "body"):
                named = named or any(says_other(WORDS.findall(part)) for part in value.split())
        elif name == "hidden" or value == "true":
            dropped = True
    return role, dropped, named


def says_other(words: list[str]) -> bool:
    return any(w in DROPPED_WORDS for w in words) and all(w in DROPPED_WORDS or w in BESIDE_WORDS for w in words)


class Block:
    """A text block: its container, whether one around it is named as something else (anywhere; or inside its article
    or main), whether it stands in one, whether that one's own name says something else, whether a tag or state around
    it leaves it out, its tag's being a heading, and how much of it is linked."""

    __slots__ = ("text", "box", "dropped", "inside", "main", "own", "tagged", "heading", "linked", "at")

    def __init__(self, text: str, box: int, dropped: bool, inside: bool, main: bool, own: bool, tagged: bool, heading: bool, linked: int, at: int):
        self.text, self.box, self.dropped, self.inside, self.main, self.own, self.tagged, self.heading, self.linked, self.at = text, box, dropped, inside, main, own, tagged, heading, linked, at


class Box:
    """A container role of a page: parent token, tag, whether it is named as something else; times, first place; text, linked text and first headings in all."""

    __slots__ = ("parent", "tag", "named", "times", "at", "chars", "linked", "titles")

    def __init__(self, parent: int, tag: str, named: bool, at: int):
        self.parent, self.tag, self.named, self.at = parent, tag, named, at
        self.times = self.chars = self.linked = self.titles = 0


def digest(text: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


ROOT = 1


def tags_of(html: str):
    """(text before, closing, tag, attributes) of each tag, and the text at the end with tag None; in linear time."""
    at, size, last = 0, len(html), html.rfind(">")
    held, plain, open_data = 0, False, True  # held: start of the text not yet given
    while (at := html.find("<", at)) >= 0:
        if at > last:  # nothing closes any more: what is cut off at the end is no text
            cut = CUT.search(html, html.rfind("<"))
            size = cut.start() if cut else size
            break
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            yield html[held:at], "", "!", ""
            at = held = end + 3 if end >= 0 else size
            continue
        if html.startswith("<![CDATA[", at) and open_data:
            end = html.find("]]>", at)
            if end >= 0:
                yield html[held:at], "", "!", ""
                at = held = end + 3
                continue
            open_data = False
        if html[at + 1 : at + 2] in ("!", "?"):
            yield html[held:at], "", "!", ""
            at = held = html.find(">", at) + 1
            continue
        m = NAME.match(html, at)
        if not m:
            at += 1
            continue
        # after an unclosed quote tags end at the next sign, so that no end is sought twice
        end = None if plain else REST.match(html, m.end())
        plain = plain or end is None
        stop = html.find(">", m.end()) + 1 if end is None else end.end()
        tag = m.group(2).lower()
        yield html[held:at], m.group(1), tag, html[m.end() : stop - 1]
        at = held = stop
        if not m.group(1) and tag in RAW and not html[m.end() : stop - 1].rstrip().endswith("/"):
            end = RAW[tag].search(html, at)
            at = held = (html.find(">", end.end()) + 1 or size) if end else size
    yield html[held:size], "", None, ""


def blocks_of(html: str) -> tuple[list[Block], dict[int, Box]]:
    """Text blocks in page order, and the containers by their token, parents first; chars and linked are of all that is inside."""
    out: list[Block] = []
    boxes = {ROOT: Box(0, "", False, 0)}
    boxes[ROOT].times = 1
    # (tag, token, dropped anywhere, dropped since the last article, in an article, its own name says so, left out by a tag)
    stack: list[tuple[str, int, bool, bool, bool, bool, bool]] = [("", ROOT, False, False, False, False, False)]
    opened: dict[str, int] = {}
    parts: list[str] = []
    anchor, linked, heading, count = 0, 0, "", 0

    def close() -> None:
        nonlocal linked, count
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                _, token, dropped, inside, main, own, tagged = stack[-1]
                count += 1
                linked = min(linked, len(text))
                out.append(Block(text, token, dropped, inside, main, own, tagged, heading != "", linked, count))
                boxes[token].chars += len(text)
                boxes[token].linked += linked
                boxes[token].titles += heading == "h1" and not dropped
            parts.clear()
        linked = 0

    for before, closing, tag, attributes in tags_of(html):
        if before:
            parts.append(before)
            linked += len(before) if anchor else 0
        if tag is None or tag == "!" or (tag in RAW and not closing):
            continue
        if closing:
            if tag == "a":
                anchor = 0
            if tag in BLOCKS:
                close()
                if tag in HEADING:
                    heading = ""
                if opened.get(tag):
                    while True:
                        was = stack.pop()[0]
                        opened[was] -= 1
                        if was == tag:
                            break
            continue
        if tag == "a":
            anchor = 1
        if tag in BLOCKS:
            close()
            anchor = anchor if tag == "br" else 0
            if tag in HEADING:
                heading = tag
            elif tag != "br":
                heading = ""
            if tag in CONTAINERS:
                _, parent, dropped, inside, main, own, tagged = stack[-1]
                role, out_by_tag, by_name = label_of(tag, attributes)
                named = out_by_tag or by_name
                token = digest(f"{parent:x}/{role}")
                fresh = tag in ("article", "main")
                # an article inside another is judged by its name; the outermost one's name only weighs
                inside = (main and (inside or named)) if fresh else inside or named
                own = (own or by_name and not main) if fresh else own
                stack.append((tag, token, dropped or named, inside, main or fresh, own, tagged or out_by_tag))
                opened[tag] = opened.get(tag, 0) + 1
                count += 1
                boxes.setdefault(token, Box(parent, tag, named, count)).times += 1
    close()
    for token, box in reversed(boxes.items()):  # children come after their parents
        if box.parent:
            boxes[box.parent].chars += box.chars
            boxes[box.parent].linked += box.linked
            boxes[box.parent].titles += box.titles
    return out, boxes


def unlinked(blocks: list[Block]) -> int:
    return sum(len(b.text) - b.linked for b in blocks)


def kept_of(blocks: list[Block], boxes: dict[int, Box]) -> list[Block]:
    """Blocks of the page's own text, judged by the page alone: those of its article, if it has one.

    Names weigh only: an article with another name counts if it has more text than all that has none, and where
    names leave nothing, the container with most unlinked text is taken, whatever it is called.
    """
    kept = [b for b in blocks if not b.dropped or (b.heading and b.main and boxes[b.box].tag == "header" and not b.own)]
    if not any(b.main for b in kept):
        nested = [b for b in blocks if b.main and not b.inside and not b.own]
        named = [b for b in blocks if b.main and not b.inside and b.own and not b.tagged]
        kept = nested or (named if unlinked(named) > unlinked(kept) else kept)
    inner = [b for b in kept if b.main]
    return inner or (kept if unlinked(kept) else densest(blocks, boxes))


def densest(blocks: list[Block], boxes: dict[int, Box]) -> list[Block]:
    """Blocks in and under the container that holds most unlinked text of its own, but for what a tag leaves out and what is made of links."""
    seen = [b for b in blocks if not b.tagged and 2 * b.linked <= len(b.text)]
    own: dict[int, int] = {}
    for b in seen:
        own[b.box] = own.get(b.box, 0) + len(b.text) - b.linked
    if not own:
        return []
    best = max(own, key=lambda k: (own[k], -boxes[k].at))
    under = {best}
    for token, box in boxes.items():  # parents come first
        if box.parent in under:
            under.add(token)
    return [b for b in seen if b.box in under]


def in_slot(blocks: list[Block], boxes: dict[int, Box], main: int, linky: set[int]) -> list[Block]:
    """Blocks inside the main slot, but for those in containers below it that are made of links or named as something else."""
    kinds = {ROOT: main == ROOT}  # in the slot; True, False, or None: left out
    for token, box in boxes.items():
        if token != ROOT:
            up = kinds[box.parent]
            kinds[token] = True if token == main else (None if up and (token in linky or box.named) else up)
    return [b for b in blocks if kinds[b.box] or (kinds[b.box] is None and b.heading and boxes[b.box].tag == "header" and kinds[boxes[b.box].parent])]


def main_text(html: str, main: int | None, template: set[int], linky: set[int]) -> str:
    """The page's own text, given the host's main slot, template text and containers of links (None: no template)."""
    blocks, boxes = blocks_of(html)
    if main is not None and main != ROOT and main in boxes:
        own = in_slot(blocks, boxes, main, linky)
        own = [b for b in own if b.main] or own  # where no slot inside the main one prevails, an article does
        own = [b for b in own if text_token(b) not in template]
        if own:
            return " ".join(b.text for b in own)
    kept = kept_of(blocks, boxes)
    if not any(b.main for b in kept):
        kept = [b for b in kept if 2 * b.linked <= len(b.text) and b.box not in linky] or densest(blocks, boxes)
    return " ".join(b.text for b in kept if text_token(b) not in template)


def text_token(b: Block) -> int:
    return digest(f"t{b.box:x}\0{b.text}")


def with_host(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html", F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#:]+)", 1).alias("host"))


COUNTS = {"token": T.LongType(), "slot": T.LongType(), "text": T.BooleanType(), "named": T.BooleanType(), "times": T.IntegerType(), "at": T.IntegerType(), "chars": T.IntegerType(), "linked": T.IntegerType(), "titles": T.IntegerType()}
#: One array for each column of COUNTS: they take far less room in a shuffle than an array of rows.
SEEN = T.StructType([T.StructField("host", T.StringType()), T.StructField("page", T.LongType()), T.StructField("copy", T.LongType()), *[T.StructField(k, T.ArrayType(t)) for k, t in COUNTS.items()]])


def page_tokens(html: str) -> tuple[int, list[list]]:
    """Digest of the page's own text (all of it, if none looks like its own), and its tokens as rows of COUNTS; slot is the container that a token stands in."""
    blocks, boxes = blocks_of(html)
    rows = {k: [k, b.parent, False, b.named, b.times, b.at, b.chars, b.linked, b.titles] for k, b in boxes.items()}
    for b in blocks:
        row = rows.setdefault(text_token(b), [text_token(b), b.box, True, False, 0, b.at, 0, 0, 0])
        row[4] += 1
        row[6] += len(b.text)
        row[7] += b.linked
    return digest("\0".join(b.text for b in kept_of(blocks, boxes) or blocks)), list(rows.values())


def tokens_of(pages: DataFrame) -> DataFrame:
    """Per page of a host: page (digest of its own text), copy (digest of its html) and its tokens."""

    def run(texts: list[str], part) -> dict:
        out: dict = {k: [] for k in SEEN.fieldNames()} | {"host": part.column("host")}
        for html in texts:
            page, rows = page_tokens(html)
            out["page"].append(page)
            out["copy"].append(digest(html))
            for k, column in zip(COUNTS, zip(*rows, strict=True), strict=True):
                out[k].append(list(column))
        return out

    return map_text(with_host(pages).filter("host <> ''").select("host", "html"), run, SEEN, text="html")


def shape_of(members: list[dict]) -> tuple[int, list[int], list[int], list[int]]:
    """Of a host's frequent tokens(token, slot, text, named, steady, vector, chars, linked, titles): the main slot, the frequent
    texts inside it, those of them that stand in a container of their own class, and the containers made of links."""
    held = {m["token"]: m for m in members if not m["text"]}
    boxes = {k: m for k, m in held.items() if m["steady"] or k == ROOT}
    # the nearest container of the template around each; a container is on every page that its contents are on
    above: dict[int, int] = {}

    def outer(token: int) -> int:
        at = held[token]["slot"]
        while at not in boxes and at in held:
            at = held[at]["slot"]
        return at if at in boxes else ROOT

    inner: dict[int, list[int]] = {}
    for k in boxes:
        if k != ROOT:
            above[k] = outer(k)
            inner.setdefault(above[k], []).append(k)
    own = lambda k: boxes[k]["chars"] - boxes[k]["linked"]
    # text in a container of its own class fills no slot; a container of nothing else is empty
    around: dict[int, tuple[list[int], bool]] = {}
    fixed = dict.fromkeys(held, 0)
    for m in members:
        if m["text"]:
            at, path, matched = m["slot"], [], False
            while at in held:
                path.append(at)
                matched |= at in boxes and m["steady"] and boxes[at]["vector"] == m["vector"]
                at = held[at]["slot"]
            around[m["token"]] = path, matched
            for k in path if matched else ():
                fixed[k] += m["chars"]
    main = ROOT
    while below := inner.get(main):
        weight = {k: own(k) * (NAMED if boxes[k]["named"] else 1.0) * (fixed[k] < boxes[k]["chars"]) for k in below}
        total = own(main) - sum(own(k) for k in below) + sum(weight.values())
        best = max(below, key=lambda k: (weight[k], -k))
        if not total or weight[best] < SHARE * total or boxes[best]["titles"] < boxes[main]["titles"]:
            break
        main = best
    inside = [t for t, (path, _) in around.items() if main in path]
    own_class = [t for t in inside if around[t][1]]
    return main, inside, own_class, [k for k, m in boxes.items() if k != main and 2 * m["linked"] > m["chars"]]


SHAPE = T.StructType([T.StructField("host", T.StringType()), T.StructField("main", T.LongType()), T.StructField("inside", T.ArrayType(T.LongType())), T.StructField("own_class", T.ArrayType(T.LongType())), T.StructField("linky", T.ArrayType(T.LongType()))])


def classes(pages: DataFrame, keep: Workspace) -> tuple[DataFrame, DataFrame]:
    """Per host its frequent tokens with the vector of their class and whether they are steady; and (host, page, token, ...) where they stand."""
    names = list(COUNTS)
    # of pages with the same text the one with the least digest, so that each counts once
    once = tokens_of(pages).groupBy("host", "page").agg(F.min_by(F.struct(*names), "copy").alias("p"))
    once = keep.write(once, "pages")
    each = once.select("host", "page", F.inline(F.arrays_zip(*[F.col(f"p.{k}").alias(k) for k in names])).alias(*names))
    # one digest of the occurrence vector for each token of a host
    first = [F.min("slot").alias("slot"), F.bool_or("text").alias("text"), F.bool_or("named").alias("named")]
    vectors = each.groupBy("host", "token").agg(F.bit_xor(F.xxhash64("page", "times")).alias("vector"), F.count(F.lit(1)).alias("support"), *first, *[F.sum(c).alias(c) for c in ("chars", "linked", "titles")])
    often = keep.write(vectors.filter(F.col("support") >= LEAST_PAGES * SUPPORT), "tokens")
    sizes = often.filter((F.col("token") == ROOT) & (F.col("support") >= LEAST_PAGES)).select("host", F.col("support").alias("pages"))
    frequent = keep.write(often.join(sizes, "host").filter(F.col("support") >= F.col("pages") * SUPPORT), "frequent")
    stands = keep.write(each.select("host", "page", "token", "at", "chars").join(frequent.select("host", "token", "vector", "text").hint("merge"), ["host", "token"]), "stands")
    place = stands.withColumn("place", F.row_number().over(Window.partitionBy("host", "page", "vector").orderBy("at", "token")))
    steady = place.groupBy("host", "token").agg((F.min("place") == F.max("place")).alias("steady"))
    return frequent.join(steady, ["host", "token"]), stands


def templates(pages: DataFrame, keep: Workspace) -> DataFrame:
    """Per host: main (token of its main slot), template (its text tokens there) and linky (containers made of links)."""
    members, stands = classes(pages, keep)
    columns = ["token", "slot", "text", "named", "steady", "vector", "chars", "linked", "titles"]
    hosts = members.groupBy("host").agg(F.collect_list(F.struct(*columns)).alias("members"))  # bounded by the average page

    def run(_: list[str], part) -> dict:
        got = [shape_of(m) for m in part.column("members").to_pylist()]
        return {"host": part.column("host")} | {c: [g[i] for g in got] for i, c in enumerate(("main", "inside", "own_class", "linky"))}

    shapes = keep.write(map_text(hosts, run, SHAPE, text="host"), "shapes")
    # pages whose main slot holds mostly frequent text are copies of one another, not pages of one template
    inside = shapes.select("host", F.explode("inside").alias("token"), F.col("own_class").alias("c")).withColumn("own_class", F.array_contains("c", F.col("token"))).drop("c")
    texts = keep.write(stands.join(keep.write(inside, "inside").hint("merge"), ["host", "token"]), "texts")
    slots = stands.join(shapes.select("host", F.col("main").alias("token")), ["host", "token"]).select("host", "page", F.col("chars").alias("whole"))
    copies = texts.groupBy("host", "page").agg(F.sum("chars").alias("common")).join(slots, ["host", "page"]).select("host", "page", (2 * F.col("common") > F.col("whole")).alias("copied"))
    judged = texts.filter("own_class").join(copies, ["host", "page"]).groupBy("host", "token").agg(F.count(F.lit(1)).alias("n"), F.count_if("copied").alias("copied"))
    template = judged.filter("copied * 2 < n").groupBy("host").agg(F.collect_list("token").alias("template"))
    return shapes.select("host", "main", "linky").join(template, "host", "left")


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    keep = Workspace(pages.sparkSession, "pages")
    # read from a written table, a host of many pages can be split in the join
    known = materialize(templates(pages, keep), "templates")
    keep.close()
    rows = with_host(pages).join(known, "host", "left").select("page_id", "url", "html", "main", "template", "linky")

    def run(texts: list[str], part: pa.RecordBatch) -> dict:
        columns = [part.column(c).to_pylist() for c in ("main", "template", "linky")]
        got = [main_text(h, m, set(t or ()), set(k or ())) for h, m, t, k in zip(texts, *columns, strict=True)]
        return {"page_id": part.column("page_id"), "url": part.column("url"), "text": got, "n_chars": [len(x) for x in got]}

    return map_text(rows, run, schema, text="html")
