"""Main text of web pages by wrapper induction over the pages of each host.

Pages are trees of slots (module ``dom``). The shapes of a host's pages are merged by
simple tree matching into one wrapper, first in parts and then per host, as a
stream of sorted rows that holds one wrapper at a time. Each page's slots are aligned with the
wrapper, and what stands in them is counted over all pages of the host: a text
that (nearly) all pages show in the same slot is template, the other slots vary.
The article is looked for among the varying slots; names and roles of elements tell menus,
notices and the like, which vary as well.

Copies of a text on one host count as one page here, so that a text copied a thousand
times does not look like a template. Pages themselves are not shuffled unless Spark
finds the table of wrappers too large to send; counts are combined before they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dom
from .common import stored, table

#: A text is template if so large a share of a host's pages that have its slot show it there ...
TEMPLATE_SHARE = 0.9
#: ... and at least so many pages, copies of a text counted once.
TEMPLATE_PAGES = 4
#: A slot outside articles is a menu if so large a share of its characters is linked.
MENU_SHARE = 0.5
#: The article holds this share of the varying text, or the page has no article element to go by.
ARTICLE_SHARE = 0.25
#: Without one, the search goes down as long as one child holds this share of its parent's text.
REGION_SHARE = 0.7
#: Parts in which a host's shapes are merged first.
PARTS = 64
#: Decisions a task keeps for shapes it has seen.
KEPT_PLANS = 4096

# Names that tell what an element is for.
NO_ARTICLE_TAGS = frozenset("nav header footer aside form dialog menu fieldset legend address".split())
NO_ARTICLE_ROLES = frozenset("""
role=navigation role=banner role=contentinfo role=complementary role=search role=form role=dialog role=alert
role=alertdialog role=menu role=menubar role=toolbar role=status hidden
""".split())
NO_ARTICLE_WORDS = frozenset("""
ad ads adv advert adverts advertisement advertising adsense sponsor sponsors sponsored promo promos promotion
promoted banner banners nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars side
aside rail widget widgets footer foot header masthead topbar toolbar comment comments commentlist commentary
respond responses reply replies disqus cookie cookies consent gdpr notice notices notification notifications
alert alerts popup modal overlay newsletter subscribe subscription signup login signin search searchbox share
sharing social related recommended recommendations trending popular pagination pager paging skip copyright
disclaimer form feedback
""".split())
#: A word after one of these tells what is around an element, not what it is.
AROUND = frozenset("has with no not without is".split())
MAIN_WORDS = frozenset("role=main role=article prop=articlebody".split())
# End of the fixed values.


def is_main(label: str) -> bool:
    return dom.tag(label) in ("article", "main") or not MAIN_WORDS.isdisjoint(label.split(" ")[1:])


def is_boilerplate(label: str) -> bool:
    """Whether an element's name or attributes say that it is no part of an article."""
    name, *marks = label.split(" ")
    if name in NO_ARTICLE_TAGS:
        return True
    for mark in marks:
        if mark in NO_ARTICLE_ROLES:
            return True
        words = mark.removeprefix("id=").split("-")
        if any(w in NO_ARTICLE_WORDS and (k == 0 or words[k - 1] not in AROUND)
               for k, w in enumerate(words)):
            return True
    return False


class Plan:
    """What pages of one shape keep: slot number of a text -> its template text or None."""

    def __init__(self, own: dom.Slot, wrapper: dom.Slot, stats: dict[int, tuple]) -> None:
        slots = list(own.walk())
        number = {id(s): k for k, s in enumerate(slots)}
        place = dom.places(wrapper, own)
        #: Characters of varying text, and whether a slot is a menu, as the whole host shows it.
        weight, menu, self.template = {}, {}, {}
        holds_main = self._marked(own)
        self.allowed: set[int] = set()
        self._allow(own, number, holds_main, inside=False)
        for k, slot in enumerate(slots):
            if slot.label == "#":
                chars, linked, template, template_chars = stats.get(place[k], (0, 0, None, 0))
                weight[k] = max(0, chars - template_chars)
                menu[k] = chars > 0 and linked > MENU_SHARE * chars
                self.template[k] = template
        under = self._sums(own, number, weight, menu)
        region, loose = self._region(own, slots, number, under)
        self.kept = {number[id(s)]: self.template[number[id(s)]] for r in region for s in r.walk()
                     if s.label == "#" and number[id(s)] in self.allowed
                     and not (loose and menu[number[id(s)]])}

    @staticmethod
    def _marked(own: dom.Slot) -> set[int]:
        """Slots that hold an article or main element which nothing closer says is none."""
        found: set[int] = set()

        def look(slot: dom.Slot) -> bool:
            below = [look(k) for k in slot.kids]
            if any(below):
                found.add(id(slot))
            boiler = is_boilerplate(slot.label)
            return is_main(slot.label) and not boiler or any(below) and (
                not boiler or dom.tag(slot.label) not in NO_ARTICLE_TAGS)

        look(own)
        return found

    def _allow(self, slot: dom.Slot, number: dict, holds_main: set[int], inside: bool) -> None:
        """Texts under no boilerplate element; of a header in an article its headings stay."""
        if slot.label == "#":
            self.allowed.add(number[id(slot)])
            return
        inside = inside or is_main(slot.label)
        for kid in slot.kids:
            if kid.label != "#" and is_boilerplate(kid.label) and (
                    id(kid) not in holds_main or dom.tag(kid.label) in NO_ARTICLE_TAGS):
                if inside and (dom.tag(kid.label) == "header" or "header" in re.split("[ -]", kid.label)):
                    for s in kid.walk():
                        if dom.tag(s.label) in dom.HEADINGS:
                            self._allow(s, number, holds_main, inside)
                continue
            self._allow(kid, number, holds_main, inside)

    def _sums(self, own, number, weight, menu) -> dict[int, tuple[int, int]]:
        """Varying characters that may be the article's, under each slot: (all, without menus)."""
        sums: dict[int, tuple[int, int]] = {}

        def add(slot: dom.Slot) -> tuple[int, int]:
            k = number[id(slot)]
            if slot.label == "#":
                own_sum = (weight[k], 0 if menu[k] else weight[k]) if k in self.allowed else (0, 0)
            else:
                below = [add(s) for s in slot.kids]
                own_sum = sum(b[0] for b in below), sum(b[1] for b in below)
            sums[k] = own_sum
            return own_sum

        add(own)
        return sums

    def _region(self, own, slots, number, under) -> tuple[list[dom.Slot], bool]:
        """The slots that hold the article; True if no element said so."""
        total = under[number[id(own)]][1]
        inner = {id(s) for top in slots if is_main(top.label) for s in top.walk() if s is not top}
        for name in ("article", "main"):
            tops = [s for s in slots if is_main(s.label) and not is_boilerplate(s.label)
                    and (dom.tag(s.label) == name or name == "article" and dom.tag(s.label) != "main"
                         and "role=main" not in s.label)
                    and (id(s) not in inner or name == "article")]
            # Of nested ones the outer; of several that with most text, and its likes.
            tops = [s for s in tops if not any(s in list(t.walk())[1:] for t in tops)]
            if tops:
                best = max(tops, key=lambda s: under[number[id(s)]][0])
                if under[number[id(best)]][0] >= ARTICLE_SHARE * total:
                    return [s for s in tops if s.label == best.label], False
        node = own
        while True:
            kids = [k for k in node.kids if k.label != "#" and dom.tag(k.label) not in dom.FLOW]
            best = max(kids, key=lambda s: under[number[id(s)]][1], default=None)
            held = under[number[id(best)]][1] if best else 0
            if not held or held < REGION_SHARE * under[number[id(node)]][1]:
                return [node], True
            node = best


def host_of(url):
    """The host in lower case; '' without one."""
    return F.lower(F.coalesce(F.regexp_extract(
        url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


SHOWN = "host string, content long, shape string, slot array<int>, value array<long>, " \
    "chars array<int>, linked array<int>"


def _slot_texts(slots: dom.Slot, leaves: list[dom.Node]) -> Iterator[tuple[int, dom.Node]]:
    for k, slot in enumerate(slots.walk()):
        for leaf in slot.leaves:
            yield k, leaves[leaf]


def _shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every page its shape and, for its texts, slot, hash and length."""
    for batch in batches:
        rows = []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
            slots, leaves = dom.page(html.as_py() or "")
            texts = list(_slot_texts(slots, leaves))
            boiler = {id(s) for top in slots.walk() if is_boilerplate(top.label) for s in top.walk()}
            own = [_hash(leaves[i].text) for s in slots.walk() if id(s) not in boiler for i in s.leaves]
            content = xxhash.xxh3_64_intdigest(b"".join(v.to_bytes(8, "big", signed=True) for v in own))
            rows.append((host, content - (1 << 63), slots.shape, [k for k, _ in texts],
                         [_hash(t.text) for _, t in texts], [len(t.text) for _, t in texts],
                         [t.linked for _, t in texts]))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()),
                 pa.list_(pa.int32()), pa.list_(pa.int32()))
        columns = list(zip(*rows)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                         names=[c.split()[0] for c in SHOWN.split(", ")])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each run of equal (host, part); rows come sorted, shapes often repeat."""
    done, last, wrapper = [], None, None
    for batch in batches:
        for host, part, shape in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
            if (host, part) != last:
                if last:
                    done.append((*last, wrapper.shape))
                last, wrapper = (host, part), dom.from_shape(shape)
            elif shape != wrapper.shape:
                dom.merge(wrapper, dom.from_shape(shape))
        if done:
            yield _wrappers(done)
            done = []
    if last:
        yield _wrappers([(*last, wrapper.shape)])


def _wrappers(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string()))],
        names=["host", "part", "wrapper"])


def induce(shapes: DataFrame) -> DataFrame:
    """(host, wrapper) from (host, shape, pages): frequent shapes come first, ties by the shape itself."""
    schema = "host string, part int, wrapper string"
    parts = shapes.select("host", F.pmod(F.xxhash64("shape"), F.lit(PARTS)).cast("int").alias("part"),
                          "shape", "pages").repartition("host", "part").sortWithinPartitions(
        "host", "part", F.desc("pages"), "shape").select("host", "part", "shape").mapInArrow(
        _merged, schema)
    return parts.select("host", F.lit(0).alias("part"), "wrapper", F.col("part").alias("order")).repartition(
        "host").sortWithinPartitions("host", "order").select("host", "part", "wrapper").mapInArrow(
        _merged, schema).select("host", "wrapper")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text and slot of the wrapper; a text that a page repeats in a slot is one row of it."""
    known: dict[tuple[str, str], list] = {}
    for batch in batches:
        out: list[tuple] = []
        for host, wrapper, shape, *texts in zip(*(c.to_pylist() for c in batch.columns)):
            key = wrapper, shape
            if key not in known:
                if len(known) >= KEPT_PLANS:
                    known.clear()
                known[key] = dom.places(dom.from_shape(wrapper), dom.from_shape(shape))
            place, rows, seen = known[key], {}, set()
            for slot, value, chars, linked in zip(*texts):
                at = place[slot]
                if at is not None:
                    old = rows.get((at, value), (0, 0))
                    rows[at, value] = old[0] + chars, old[1] + linked
            for (at, value), (chars, linked) in rows.items():
                out.append((host, at, value, chars, linked, int(at not in seen)))
                seen.add(at)
        kinds = (pa.string(), pa.int32(), *(pa.int64(),) * 4)
        columns = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                         names=["host", "slot", "value", "chars", "linked", "pages"])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, stats) from (host, html): the induced wrapper and what its slots show.

    ``stats`` has for each slot with texts: slot, chars, linked, template, template_chars.
    """
    # One page of those whose texts outside menus and the like are equal.
    one = F.min(F.struct("shape", "slot", "value", "chars", "linked"))
    shown = stored(pages.select("host", "html").mapInArrow(_shown, SHOWN).groupBy(
        "host", "content").agg(one.alias("p")).select("host", "p.*"), "page-shapes")
    wrapper = stored(induce(shown.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages"))),
                     "wrappers")
    placed = shown.join(wrapper, "host").select(
        "host", "wrapper", "shape", "slot", "value", "chars", "linked").mapInArrow(
        _placed, "host string, slot int, value long, chars long, linked long, pages long")
    values = placed.groupBy("host", "slot", "value").agg(
        F.count(F.lit(1)).alias("shown"), *(F.sum(c).alias(c) for c in ("chars", "linked", "pages")))
    top = F.max(F.struct("shown", "value", "chars"))
    slots = values.groupBy("host", "slot").agg(
        *(F.sum(c).alias(c) for c in ("chars", "linked", "pages")), top.alias("top"))
    is_template = (F.col("top.shown") >= TEMPLATE_PAGES) & (
        F.col("top.shown") >= F.col("pages") * TEMPLATE_SHARE)
    stats = slots.select("host", F.struct(
        "slot", "chars", "linked", F.when(is_template, F.col("top.value")).alias("template"),
        F.when(is_template, F.col("top.chars")).otherwise(0).alias("template_chars")).alias("s")).groupBy(
        F.col("host").alias("of")).agg(F.collect_list("s").alias("stats"))
    return stored(wrapper.join(stats, F.col("host") == F.col("of"), "left").select(
        "host", "wrapper", "stats"), "host-wrappers")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    plans: dict[tuple[str, str], Plan] = {}
    last: dict[str, tuple] = {}
    for batch in batches:
        made = []
        for host, html, wrapper, stats in zip(*batch.columns[2:]):
            host = host.as_py()
            slots, leaves = dom.page(html.as_py() or "")
            key = host, slots.shape
            if key not in plans:
                if len(plans) >= KEPT_PLANS:
                    plans.clear()
                by_slot = {s["slot"]: (s["chars"], s["linked"], s["template"], s["template_chars"])
                           for s in stats.as_py() or ()}
                plans[key] = Plan(slots, dom.from_shape(wrapper.as_py()), by_slot)
            kept = plans[key].kept
            chosen = sorted(i for k, slot in enumerate(slots.walk()) if k in kept for i in slot.leaves
                            if kept[k] is None or kept[k] != _hash(leaves[i].text))
            made.append("\n".join([leaves[i].text for i in chosen]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(made, pa.string()),
             pa.array([len(t) for t in made], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    The text is the article's blocks in page order, one to a line, with character references
    decoded and white space (any that Unicode calls so) as one blank; '' if there is none.
    Null and empty html give ''. Pages without a host, null urls included, share one host ''.
    Repeated rows give repeated results and count once for the wrapper; null ids stay; other
    columns are not read; an empty table gives no rows. Very long pages are held one at a time; elements
    nested deeper than ``dom.DEPTH`` hang on the deepest one allowed.
    """
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url",
                       host_of(F.col("url")).alias("host"), "html")
    rules = wrappers(own).withColumnRenamed("host", "of")
    # Left to Spark by size: a small table of wrappers is sent, a large one is joined by host.
    return own.join(rules, F.col("host") == F.col("of"), "left").select(
        "page_id", "url", "host", "html", "wrapper", "stats").mapInArrow(
        _texts, "page_id long, url string, text string, n_chars long")


def op13_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
