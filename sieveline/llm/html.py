"""Main text of web pages: flat text blocks classified by a small decision tree.

Markup is read once into a flat list of text blocks. A block is described by its number of words
and its link density, by those of the blocks before and after it, and by where it stands (inside
navigation and the like, under a telling class or id, inside the article, a heading). A decision
tree, fitted with Spark ML on the blocks of a few labelled pages, tells main text from the rest.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession

from sieveline.llm.html_examples import PAGES
from sieveline.session import local_frame, ship_package

# Fixed values of HTML: elements that end a block of text, whose content is not text, that are empty.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul label".split()
)
_SILENT = "script style noscript template title textarea select button svg math iframe object canvas audio video".split()
# Of these, the ones that nothing follows where the tag itself ends in a slash.
_CLOSABLE = "svg math button select object canvas audio video template noscript".split()
_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FRAMES = frozenset("nav footer aside form menu dialog header".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in a class, id or role that tell what is not the main text.
_HINTS = re.compile(
    r"(?:^|[\s_-])(?<!has[_-])(?<!with[_-])(?<!no[_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promos?|promotions?|banners?|cookies?|consent|gdpr|"
    r"notices?|alerts?|popups?|modals?|overlay|newsletters?|subscribe|subscription|signup|login|sidebars?|widgets?|related|"
    r"recommend(?:ed|ations?)?|shar(?:e|ing)|social|menus?|nav|navbar|navigation|navigations|breadcrumbs?|pagination|pager|comments?|disqus|"
    r"repl(?:y|ies)|respond|footers?|masthead|toolbar|copyright|legal|disclaimers?|contentinfo|complementary|search|skip)(?:$|[\s_-])",
    re.I,
)
# Those of them that count on an article or main element too, which notices and the like may be about.
_ARTICLE_HINTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|sponsor(?:ed|s)?|promos?|related|recommend(?:ed|ations?)?|comments?|disqus|repl(?:y|ies))(?:$|[\s_-])", re.I
)
_MAIN = re.compile(r"(?:^|\s)main(?:$|\s)", re.I)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?:{'|'.join(_CLOSABLE)})(?=[\s/])[^>]*+(?<=/)>"
    rf"|<({'|'.join(_SILENT)})(?=[\s/>])[^>]*+>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)(?:>|\Z)"""
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", re.I)

FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "framed", "hinted", "in_main", "heading",
)


class _Block:
    __slots__ = ("parts", "linked", "framed", "hinted", "main", "heading")

    def __init__(self):
        self.parts: list[str] = []
        self.linked = 0


def blocks(page: str | None) -> list[tuple[str, float, bool, bool, bool, bool]]:
    """(text, link density, framed, hinted, in main, heading) of each block with text, in page order.

    Broken markup is read as far as it goes: what is open stays open, what closes nothing is
    ignored, an unfinished tag at the end is dropped. Character references are decoded and white
    space becomes one space.
    """
    out = []
    open_: list[tuple[str, int, int, int, int]] = []
    counts: dict[str, int] = {}
    framed = hinted = main = heading = links = 0
    paragraph = False  # whether the paragraph's own class or id tells that it is not main text
    block, around = _Block(), None  # around: the block that a telling inline element interrupts
    page = page or ""

    def emit(done: _Block):
        text = " ".join("".join(done.parts).split())
        if text:
            words = text.count(" ") + 1
            out.append((text, min(1.0, done.linked / words), done.framed, done.hinted, done.main, done.heading))

    def close():
        nonlocal block, around, paragraph
        emit(block)
        if around is not None:
            emit(around)
        block, around, paragraph = _Block(), None, False

    def add(raw: str):
        text = entities.unescape(raw)
        if not block.parts or not "".join(block.parts).strip():
            block.framed, block.hinted, block.main, block.heading = framed > 0, hinted > 0 or paragraph, main > 0, heading > 0
        block.parts.append(text)
        if links:
            block.linked += len(text.split())

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        ending = token[2] if token[3] else token[5]
        name = token[3] or token[6]
        if not name:
            if block.parts:
                block.parts.append(" " if token[1] else "")
            continue
        if not token[0].endswith(">"):
            continue
        tag = name.lower()
        if tag in _BLOCKS:
            close()
        elif tag == "br":
            block.parts.append(" ")
        if tag == "a":
            links = 0 if ending else 1  # links do not nest
            continue
        if tag in _EMPTY or (tag not in _BLOCKS and tag != "span"):
            continue
        if ending:
            if counts.get(tag):
                while open_:
                    last, *was = open_.pop()
                    counts[last] -= 1
                    framed, hinted, main, heading = was
                    if last == tag:
                        break
                if around is not None and not hinted:
                    emit(block)
                    block, around = around, None
        else:
            attributes = token[4] if token[3] else token[7]
            found = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)] if attributes else []
            if tag == "p":
                paragraph = any(_HINTS.search(v) for _, v in found)
                continue
            open_.append((tag, framed, hinted, main, heading))
            counts[tag] = counts.get(tag, 0) + 1
            if tag in ("article", "main") or any(k == "role" and _MAIN.search(v) for k, v in found):
                main += 1
            if tag in _FRAMES and not (tag == "header" and main):
                framed += 1
            telling = _ARTICLE_HINTS if tag in ("article", "main") else _HINTS
            if tag not in ("html", "body") and any(telling.search(v) for _, v in found):
                if tag == "span" and not hinted and not paragraph:
                    block, around = _Block(), block
                hinted += 1
            if tag in _HEADINGS:
                heading += 1
    if at < len(page):
        add(page[at:])
    close()
    return out


def features(found: list[tuple[str, float, bool, bool, bool, bool]]) -> list[list[float]]:
    """One row of FEATURES per block; beyond the page there are no words and no links."""
    sizes = [0.0, *[float(b[0].count(" ") + 1) for b in found], 0.0]
    links = [0.0, *[b[1] for b in found], 0.0]
    return [
        [sizes[i + 1], links[i + 1], sizes[i], links[i], sizes[i + 2], links[i + 2], *map(float, b[2:])] for i, b in enumerate(found)
    ]


def labelled_blocks(spark: SparkSession, pages: tuple[str, ...] = PAGES) -> DataFrame:
    """The labelled table: FEATURES and label of the blocks of the example pages."""
    rows = []
    for page in pages:
        found = blocks(page)
        rows += [(*f, float(b[0][0] == "+")) for f, b in zip(features([(b[0], *b[1:]) for b in found]), found)]
    return local_frame(spark, rows, ", ".join(f"{c} double" for c in (*FEATURES, "label")))


def fit_tree(labelled: DataFrame, depth: int = 8):
    """Nested (feature, threshold, low, high) of a decision tree fitted with Spark ML; leaves are bool."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labelled.coalesce(1))
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=256, minInstancesPerNode=1, seed=1).fit(rows)

    def nested(node):
        if node.subtreeDepth() == 0:
            return node.prediction() == 1.0
        split = node.split()
        return split.featureIndex(), split.threshold(), nested(node.leftChild()), nested(node.rightChild())

    return nested(model._java_obj.rootNode())


def _decide(tree, row: list[float]) -> bool:
    while not isinstance(tree, bool):
        feature, threshold, low, high = tree
        tree = low if row[feature] <= threshold else high
    return tree


def main_text(page: str | None, tree) -> str:
    found = blocks(page)
    return "\n".join(b[0] for b, row in zip(found, features(found)) if _decide(tree, row))


def extract(pages: DataFrame, tree=None) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of `pages` (page_id, url, html).

    text is the main text, its blocks joined by line feeds: empty for a null or empty page or one
    without main text. n_chars counts its code points. Pages stay where they are read; the tree is
    a few hundred numbers.
    """
    ship_package(pages.sparkSession)
    tree = fit_tree(labelled_blocks(pages.sparkSession)) if tree is None else tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), tree) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
