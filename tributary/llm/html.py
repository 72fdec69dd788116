"""Main text of web pages: flat text blocks, classified by a decision tree over their and their neighbours' shape."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.html_labels import LABELLED_PAGES, MARK

#: Elements that stay inside the block around them; all others start a new block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr picture source".split()
)
#: Elements whose content is no text of the page. A head has no text of its own: what is not one of its elements ends it.
HIDDEN = frozenset("script style noscript template svg math title iframe object canvas select option textarea button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Drawings and formulas, and elements that can't be in them, so that they end one left open.
FOREIGN = frozenset("svg math".split())
ENDS_FOREIGN = frozenset(
    "article aside blockquote body center dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split()
)
#: Elements that an opening of the same kind ends, unless one of the containers stands between.
ENDS_SAME = frozenset("p li dt dd tr td th option".split())
CONTAINERS = frozenset("ul ol dl table div section article main body".split())
#: Parts of a page by element or role.
OUTSIDE = frozenset("nav footer aside form menu dialog header banner navigation contentinfo complementary search".split())
INSIDE = frozenset("article main".split())
#: Words in a class or id that name what is not the article.
SIDE_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie consent copyright disclaimer footer "
    "form header legal login masthead menu modal nav navbar navigation newsletter notice notices pagination popup "
    "promo promotion related replies reply share sharing sidebar signup social sponsor sponsored subscribe toolbar "
    "widget".split()
)
#: First words of a name that says what the page has, not what the element is.
HAVING = frozenset("has have with without no is show hide".split())
FEATURES = (
    "words", "link_share", "words_before", "link_share_before", "words_after", "link_share_after",
    "inside", "outside", "side_word", "heading", "paragraph", "item", "above", "below",
)
MARKS = ("inside", "outside", "side_word", "heading", "paragraph", "item", "label")
#: Words of a long block, most linked words in a hundred of it, and how many long blocks above and below are counted.
LONG_WORDS, LONG_LINKED, LONG_COUNTED = 12, 45, 3
BLOCK = "array<struct<text:string,words:int,linked:int,inside:int,outside:int,side_word:int,heading:int,paragraph:int,item:int,label:int,above:int,below:int>>"
TREE_DEPTH = 9


def _side_name(given: dict[str, str]) -> bool:
    """Whether a class or id names something beside the article; ``has-sidebar`` and the like don't."""
    for name in f"{given.get('class', '')} {given.get('id', '')}".lower().split():
        words = name.replace("_", "-").split("-")
        if words[0] not in HAVING and not SIDE_WORDS.isdisjoint(words):
            return True
    return False


def _not_shown(given: dict[str, str]) -> bool:
    return "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").lower().replace(" ", "")


class _Blocks(HTMLParser):
    """Cuts a page into flat text blocks with the counts the tree needs.

    ``places`` has the positions of open elements by name, so that an end tag
    finds its element at once, however deep the page is.
    """

    def __init__(self, labelled: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.labelled = labelled
        self.open: list[tuple[str, dict]] = []
        self.places: dict[str, list[int]] = {}
        self.containers: list[int] = []
        self.blocks: list[dict] = []
        self.parts: list[str] = []
        self.linked = 0
        self.top = dict.fromkeys(("hidden", "link", *MARKS), 0) | {"label": -1}

    @property
    def state(self) -> dict:
        return self.open[-1][1] if self.open else self.top

    def cut(self) -> None:
        """End the block that is being read."""
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append({"text": text, "words": text.count(" ") + 1, "linked": self.linked, **{k: self.state[k] for k in MARKS}})
        self.parts, self.linked = [], 0

    def _push(self, tag: str, state: dict) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in CONTAINERS:
            self.containers.append(len(self.open))
        self.open.append((tag, state))

    def _close(self, tag: str, within: bool = False) -> None:
        """Leave the last open element of this kind, and all in it; ``within``: unless a container stands between."""
        at = self.places.get(tag)
        if not at or (within and self.containers and self.containers[-1] > at[-1]):
            return
        keep = at[-1]
        for name, _ in reversed(self.open[keep:]):
            self.places[name].pop()
            if name in CONTAINERS:
                self.containers.pop()
        del self.open[keep:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k: v or "" for k, v in attrs}
        if tag in INLINE:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "a":
                # A link in a link can't be: the first was left open.
                self._close("a", within=True)
                self._push(tag, self.state | {"link": int("href" in given), "hidden": int(self.state["hidden"] or _not_shown(given))})
            elif tag not in VOID and (self.state["hidden"] or _not_shown(given)):
                self._push(tag, self.state | {"hidden": 1})
            return
        self.cut()
        if tag in ENDS_FOREIGN:
            for name in FOREIGN:
                self._close(name)
        if tag in ENDS_SAME:
            self._close(tag, within=True)
        if tag in VOID:
            return
        now = self.state
        names = {tag, given.get("role", "").lower()}
        own_name = tag not in ("html", "body") and _side_name(given)
        inside = not own_name and bool(names & INSIDE)
        label = given.get(MARK) if self.labelled else None
        # A header or form inside the article may still hold its title; the tree sees both marks.
        self._push(tag, now | {
            "hidden": int(now["hidden"] or tag in HIDDEN or _not_shown(given)),
            "inside": int(now["inside"] or inside),
            "outside": int(now["outside"] or bool(names & OUTSIDE)),
            # What holds the article is not beside it, whatever its name.
            "side_word": int(own_name or (now["side_word"] and not inside)),
            "heading": int(len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()),
            "paragraph": int(tag in ("p", "blockquote", "pre", "figcaption")),
            "item": int(tag in ("li", "dt", "dd", "td", "th")),
            "label": int(label) if label in ("0", "1") else now["label"],
        })

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.cut()
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if self.state["hidden"]:
            return
        self.parts.append(data)
        if self.state["link"]:
            self.linked += len(data.split())


def page_blocks(page: str | None, labelled: bool = False) -> list[dict]:
    """Text blocks of a page in order; none for a null page or one without text.

    ``above`` and ``below`` count long blocks of few links on either side, up to
    ``LONG_COUNTED``. Only ``labelled`` pages are asked for labels.
    """
    parser = _Blocks(labelled)
    parser.feed(page or "")
    parser.close()
    parser.cut()
    for side, blocks in (("above", parser.blocks), ("below", parser.blocks[::-1])):
        seen = 0
        for b in blocks:
            b[side] = min(seen, LONG_COUNTED)
            seen += b["words"] >= LONG_WORDS and 100 * b["linked"] <= LONG_LINKED * b["words"]
    return parser.blocks


def with_blocks(pages: DataFrame, html_col: str = "html", labelled: bool = False) -> DataFrame:
    """``pages`` with ``blocks``, an array in page order, in place of a column of that name."""
    kept = [c for c in pages.columns if c != "blocks"]
    rows = pages.select(*[pages[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(kept)], pages[f"`{html_col}`"].alias("__html"))
    kinds = "".join(f"c{i} {pages.schema[c].dataType.simpleString()}, " for i, c in enumerate(kept)) + f"blocks {BLOCK}"
    fields = ("words", "linked", *MARKS, "above", "below")
    kind = pa.list_(pa.struct([("text", pa.string()), *((f, pa.int32()) for f in fields)]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                *own, texts = part.columns
                blocks = pa.array([page_blocks(x.as_py(), labelled) for x in texts], kind)
                yield pa.RecordBatch.from_arrays([*own, blocks], [*part.schema.names[:-1], "blocks"])

    return rows.mapInArrow(run, kinds).withColumnsRenamed({f"c{i}": c for i, c in enumerate(kept)})


def block_features(blocks: Column) -> Column:
    """Array of feature arrays, one per block, in the order of ``FEATURES``; a missing neighbour counts as empty."""

    def share(block: Column) -> Column:
        return F.coalesce(block["linked"] / block["words"], F.lit(0.0))

    def features(block: Column, i: Column) -> Column:
        before, after = F.get(blocks, i - 1), F.get(blocks, i + 1)
        cells = [block["words"], share(block), before["words"], share(before), after["words"], share(after)]
        cells += [block[k] for k in FEATURES[6:]]
        return F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in cells])

    return F.transform(blocks, features)


def train_tree(spark: SparkSession, labelled: list[str] | None = None, depth: int = TREE_DEPTH) -> str:
    """SQL over ``f``, a block's features, that is true for main text: a decision tree of the labelled pages.

    ``labelled`` are pages whose elements carry the label in an attribute: a
    table of a few dozen rows, whatever the corpus.
    """
    pages = spark.createDataFrame([(x,) for x in (LABELLED_PAGES if labelled is None else labelled)], "html string")
    blocks = with_blocks(pages, labelled=True).select(F.explode(F.arrays_zip(block_features(F.col("blocks")).alias("f"), F.col("blocks.label").alias("y"))).alias("b"))
    rows = blocks.select(array_to_vector(F.col("b.f")).alias("features"), F.col("b.y").cast("double").alias("label")).where("label >= 0")
    tree = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=1, seed=1).fit(rows.coalesce(1))
    return tree_sql(tree.toDebugString)


def tree_sql(debug: str) -> str:
    """The printed tree as nested CASE expressions."""
    lines = [line.strip() for line in debug.splitlines()[1:] if line.strip()]

    def read() -> str:
        line = lines.pop(0)
        if line.startswith("Predict:"):
            return "true" if float(line.split(":")[1]) >= 0.5 else "false"
        feature, threshold = line[line.index("feature") + 7 : -1].split("<=")
        below = read()
        lines.pop(0)  # Else
        return f"CASE WHEN f[{int(feature)}] <= {float(threshold)!r}D THEN {below} ELSE {read()} END"

    return read()


def main_text(pages: DataFrame, html_col: str = "html", tree: str | None = None) -> DataFrame:
    """``pages`` with ``blocks, text, n_chars``: all blocks with their verdict ``main``, the main ones joined, its code points.

    Each page is read by itself, without a shuffle. A null or empty page has an
    empty text; broken markup is read as far as it goes. Columns of these names
    in ``pages`` are replaced, others stay.
    """
    rule = tree if tree is not None else train_tree(pages.sparkSession)
    cut = with_blocks(pages, html_col).withColumn("__f", block_features(F.col("blocks")))
    verdicts = F.expr(f"transform(__f, f -> {rule})")
    judged = cut.withColumn("blocks", F.zip_with("blocks", verdicts, lambda b, m: b.dropFields("label").withField("main", m)))
    texts = F.transform(F.filter("blocks", lambda b: b["main"]), lambda b: b["text"])
    judged = judged.drop("__f").withColumn("text", F.array_join(texts, "\n\n"))
    return judged.withColumn("n_chars", F.char_length("text").cast("long"))
