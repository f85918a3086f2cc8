"""Jobs of archived boards by the template of each kind of board: their ids, title candidates in order, teams and locations, and what makes a page partial.

A streaming parser turns a page into rows of elements; all that a template says about them (cards, groups, headings, selectors) is joins and aggregates over these rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from larkspur.functions.scalars import blank_to_null, normalized_text, ratio
from larkspur.operators.matching import junk_title
from larkspur.session import ship, written
from larkspur.sources.boards import UUID, declared_total

# Classes that hold a job's metadata, attributes that hold titles (best first), classes that templates select by, and the addresses of boards.
METADATA = ("posting-categories", "posting-category", "tag-container", "sort-by-location", "sort-by-commitment", "sort-by-time", "workplaceTypes", "location", "commitment", "job-location", "body--metadata")
TITLE_ATTRIBUTES = ("aria-label", "data-title", "data-job-title", "title")
SELECTED = ("posting", "postings-group", "posting-apply", "posting-title", "posting-categories", "posting-category-title", "large-category-header", "sort-by-location", "job-posts--table--department", "section-header", "location", "job-location")
ASHBY_BOARD = "https://jobs.ashbyhq.com/"
NUMBERED = "/jobs/([0-9]+)/?(?:[?#].*)?$"
TENANT = "greenhouse\\.io/([^/?#]+)/jobs/[0-9]+"
APP_DATA = "window\\s*\\.\\s*__appData\\s*=\\s*"

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
KEPT = (*HEADINGS, "a", "p", "tr", "li")
#: A new element of these names ends an open one of its name, unless one of the others lies between.
BLOCKS = frozenset("div td th table ul ol li tr section article main aside header footer nav form".split())
ENDED_BY = {**dict.fromkeys((*HEADINGS, "a", "p"), BLOCKS), "li": frozenset(("ul", "ol", "table")), "tr": frozenset(("table",))}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ATTRIBUTES = ("href", "data-qa", "data-qa-posting-id", *TITLE_ATTRIBUTES)
#: So many headings before an element are looked at for one with a text.
ABOVE = 3
#: So many elements, at least, are handed on at once.
BATCH = 4096
ELEMENT = "page_id long, kind string, tenant string, place int, tag string, classes array<string>, attrs map<string,string>, path array<int>, inside array<string>, nth int, text string, inner string, above string, tr int, li int, postings int, department int"


_SELECTED, _METADATA, _TITLED = frozenset(SELECTED), frozenset(METADATA), frozenset(("posting-category-title", "large-category-header", "sort-by-location", "location", "job-location"))


class _Elements(HTMLParser):
    """The elements of a page in order: each with its open ancestors and the span of text pieces that it holds."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found, self.open, self.pieces, self.headings, self.children = [], [], [], [], [{}]

    def handle_starttag(self, tag, attrs):
        if tag in KEPT:
            self._end(tag, ENDED_BY[tag])
        given = {k: v or "" for k, v in attrs}
        classes = given.get("class", "").split()
        nth = self.children[-1].setdefault(tag, 0)
        self.children[-1][tag] += 1
        e = {"place": len(self.found), "tag": tag, "classes": classes, "attrs": given, "up": list(self.open), "nth": nth, "from": len(self.pieces), "to": len(self.pieces), "skip": [], "above": self.headings[-ABOVE:]}
        self.found.append(e)
        if tag in HEADINGS:
            self.headings.append(e)
        if tag not in VOID:
            self.open.append(e)
            self.children.append({})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._end(tag, ())

    def handle_data(self, data):
        if not self.open or self.open[-1]["tag"] not in ("script", "style"):
            self.pieces.append(data)

    def _end(self, tag, until):
        """Close the innermost open tag unless another one of until lies within it."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                self._close(i)
                return
            if self.open[i]["tag"] in until:
                return

    def _close(self, i):
        for e in reversed(self.open[i:]):
            e["to"] = len(self.pieces)
            if e["up"] and not _METADATA.isdisjoint(e["classes"]):
                e["up"][-1]["skip"].append((e["from"], e["to"]))
        del self.open[i:], self.children[i + 1 :]

    def text(self, e, skip=()):
        """The pieces of an element but for some spans, their ends stripped and joined by a space; null if blank."""
        out, at = [], e["from"]
        for a, b in [*skip, (e["to"], e["to"])]:
            out += self.pieces[at:a]
            at = b
        return re.sub(r"\s+", " ", " ".join(out)).strip() or None

    def rows(self) -> Iterator[dict]:
        self.close()
        self._close(0)
        cards = {e["up"][-1]["place"] for e in self.found if e["tag"] == "a" and e["up"]}
        kept = {e["place"] for e in self.found if e["tag"] in KEPT or not _SELECTED.isdisjoint(e["classes"])} | cards
        headings: dict[int, str | None] = {}

        def heading(h):
            if h["place"] not in headings:
                headings[h["place"]] = self.text(h)
            return headings[h["place"]]

        for e in self.found:
            if e["place"] not in kept:
                continue
            tag, up, hits = e["tag"], e["up"], [c for c in e["classes"] if c in _SELECTED]
            whole = tag in ("a", "p", *HEADINGS) or not _TITLED.isdisjoint(hits)
            parent = up[-1]["place"] if up else -1
            # the nearest of each kind is the last one on the way down
            near, inside = {"tr": None, "li": None, "postings": None, "department": None}, set()
            for u in up:
                if u["tag"] in ("tr", "li"):
                    near[u["tag"]] = u["place"]
                if u["classes"]:
                    inside.update(_SELECTED.intersection(u["classes"]))
                    if "postings-group" in u["classes"]:
                        near["postings"] = u["place"]
                    if "job-posts--table--department" in u["classes"]:
                        near["department"] = u["place"]
            yield {
                "place": e["place"], "tag": tag, "classes": hits, "attrs": [(k, e["attrs"][k]) for k in ATTRIBUTES if k in e["attrs"]], "path": [u["place"] for u in up if u["place"] in kept or u["place"] == parent],
                "inside": sorted(inside), "nth": e["nth"], "text": self.text(e) if whole else None, "inner": self.text(e, e["skip"]) if tag in ("a", "p") else None, "above": next((t for h in reversed(e["above"]) if (t := heading(h))), None), **near,
            }


def elements(pages: DataFrame) -> DataFrame:
    """The elements of pages (page_id, kind, tenant, html) that templates look at, those around anchors included: place in the page, classes, attributes, ancestors (the nearest row, item, group and department by name), text, text without metadata, and the nearest heading before. Null and empty pages have none."""
    ship(pages.sparkSession)

    schema = to_arrow_schema(T._parse_datatype_string(ELEMENT))

    def parse(batches):
        rows: list[dict] = []
        for b in batches:
            for page_id, kind, tenant, html in zip(*(b.column(i) for i in range(4)), strict=True):
                p = _Elements()
                p.feed(html.as_py())
                page = {"page_id": page_id.as_py(), "kind": kind.as_py(), "tenant": tenant.as_py()}
                rows += [page | r for r in p.rows()]
                if len(rows) >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pages.filter("html is not null and html <> ''").select(F.col("page_id").cast("long").alias("page_id"), "kind", "tenant", "html").mapInArrow(parse, ELEMENT)


def has(name: str) -> Column:
    return F.array_contains("classes", name)


def within(name: str) -> Column:
    return F.array_contains("inside", name)


def first(value: Column | str, where: Column) -> Column:
    """The value of the first element within a scope that a condition selects, blank or not."""
    return F.min_by(value, F.when(where & (F.col("place") > F.col("scope")), F.col("place")))


def scopes(found: DataFrame) -> DataFrame:
    """What each element holds: page_id, scope (its place), its attributes, and its first heading, selected texts, paragraphs of its own and anchors."""
    own = F.try_element_at("path", F.lit(-1)) == F.col("scope")
    anchor = F.struct("place", "attrs", "inner", "above")
    heading = F.col("tag").isin(*HEADINGS) & F.col("text").isNotNull()
    return found.select("*", F.explode(F.array_append("path", F.col("place"))).alias("scope")).groupBy("page_id", "scope").agg(
        F.min_by("attrs", F.when(F.col("place") == F.col("scope"), 0)).alias("attrs"),
        first("text", heading).alias("heading"), first("text", (F.col("tag") == "h5") & (F.col("attrs")["data-qa"] == "posting-name")).alias("posting_name"), first("text", (F.col("tag") == "h5") & within("posting-title")).alias("posting_heading"),
        first("text", has("posting-category-title")).alias("category"), first("text", has("large-category-header")).alias("header"), first("text", (F.col("tag") == "h3") & has("section-header")).alias("section"), first("text", F.col("tag") == "h3").alias("h3"),
        first("text", has("sort-by-location") & within("posting-categories")).alias("category_location"), first("text", has("sort-by-location")).alias("sort_location"), first("text", has("location") | has("job-location")).alias("location"),
        first("inner", (F.col("tag") == "p") & own & (F.col("nth") == 0)).alias("p1"), first("text", (F.col("tag") == "p") & own & (F.col("nth") == 1)).alias("p2"),
        first(anchor, (F.col("tag") == "a") & has("posting-title")).alias("title_anchor"), first(anchor, (F.col("tag") == "a") & F.col("attrs")["href"].isNotNull() & ~within("posting-apply")).alias("other_anchor"),
    )


def candidates(primary: list[Column], card: Column, anchor: Column, above: Column, min_chars: int) -> Column:
    """Title candidates, best first, each once: the template's own, the card's heading, attributes of anchor and card, the anchor's text without metadata; the heading before only where all of these are junk."""
    named = [blank_to_null(side["attrs"][a]) for side in (anchor, card) for a in TITLE_ATTRIBUTES]
    found = F.array_distinct(F.array_compact(F.array(*primary, card["heading"], *named, anchor["inner"])))
    return F.when(F.forall(found, lambda t: junk_title(t, min_chars).isNotNull()), F.array_distinct(F.array_compact(F.concat(found, F.array(above))))).otherwise(found)


def holding(rows: DataFrame, held: DataFrame, scope: Column, name: str) -> DataFrame:
    """Elements with what the element at scope holds, as a struct of that name."""
    side = held.select(F.col("page_id").alias("__p"), F.col("scope").alias("__s"), F.struct(*[c for c in held.columns if c not in ("page_id", "scope")]).alias(name))
    return rows.join(side, (F.col("page_id") == F.col("__p")) & (scope == F.col("__s")), "left").drop("__p", "__s")


def lever(found: DataFrame, held: DataFrame, min_chars: int) -> DataFrame:
    """Cards of div.posting. A group's category is the team; its department, carried on to groups without one, stands in."""
    posts = found.filter((F.col("kind") == "lever") & (F.col("tag") == "div") & has("posting"))
    rows = holding(holding(posts, held, F.col("place"), "card"), held, F.col("postings"), "outer")
    order = Window.partitionBy("page_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("department", F.last(F.col("outer")["header"], ignorenulls=True).over(order)).withColumn("anchor", F.coalesce(F.col("card")["title_anchor"], F.col("card")["other_anchor"]))
    href, card = F.col("anchor")["attrs"]["href"], F.col("card")
    job = F.coalesce(blank_to_null(F.col("attrs")["data-qa-posting-id"]), F.nullif(F.regexp_extract(href, "/" + UUID, 1), F.lit("")))
    above = F.when(F.col("anchor").isNotNull(), F.col("anchor")["above"]).otherwise(F.col("above"))
    titles = candidates([card["posting_name"], card["posting_heading"]], card, F.col("anchor"), above, min_chars)
    return rows.select("page_id", "place", job.alias("job_id"), titles.alias("titles"), F.coalesce(F.col("outer")["category"], "department").alias("team"), F.coalesce(card["category_location"], card["sort_location"]).alias("location"), href.alias("url")).filter("job_id is not null")


def _same_tenant(href: Column) -> Column:
    """False where an address names another tenant's board."""
    other = F.regexp_extract(href, TENANT, 1)
    return (other == "") | (F.lower(other) == F.lower("tenant"))


def greenhouse(found: DataFrame, held: DataFrame, min_chars: int) -> DataFrame:
    """Anchors whose address ends in a job's number, of this tenant or of none; a first and second paragraph within are title and location. Without a department's table the heading above is the team, unless it is junk."""
    href = F.col("attrs")["href"]
    links = found.filter((F.col("kind") == "greenhouse") & (F.col("tag") == "a") & href.rlike(NUMBERED) & _same_tenant(href))
    at = F.coalesce("tr", F.try_element_at("path", F.lit(-1)), "place")
    rows = holding(holding(holding(links, held, at, "card"), held, F.col("place"), "own"), held, F.col("department"), "outer")
    own, card, outer = F.col("own"), F.col("card"), F.col("outer")
    titles = candidates([own["p1"]], card, F.struct("attrs", "inner"), F.col("above"), min_chars)
    heading = F.when(junk_title("above", 1).isNull(), F.col("above"))
    return rows.select("page_id", "place", F.regexp_extract(href, NUMBERED, 1).alias("job_id"), titles.alias("titles"), F.coalesce(outer["section"], outer["h3"], heading).alias("team"), F.coalesce(own["p2"], card["location"]).alias("location"), href.alias("url"))


def ashby(pages: DataFrame) -> DataFrame:
    """Boards inlined as one JSON object behind an assignment in a script: it is read from its first brace to the brace that balances it, whatever follows. A broken object gives no jobs. Numbers for titles are read as texts."""
    start = F.regexp_instr("html", F.lit(APP_DATA))
    text = F.regexp_extract(F.substring("html", start, F.length("html")), "(?s)^" + APP_DATA + "[^{]*(\\{.*)$", 1)
    data = "jobBoard struct<jobPostings: array<struct<id: string, title: string, locationName: string, teamId: string>>, teams: array<struct<id: string, name: string, externalName: string>>>"
    board = pages.filter(start > 0).select("page_id", "tenant", F.from_json(text, data)["jobBoard"].alias("board"))
    rows = board.select("page_id", "tenant", F.col("board")["teams"].alias("teams"), F.posexplode(F.col("board")["jobPostings"]).alias("place", "job"))
    label = lambda t: F.coalesce(blank_to_null(t["externalName"]), blank_to_null(t["name"]))
    team = F.try_element_at(F.filter("teams", lambda t: (t["id"] == F.col("job")["teamId"]) & label(t).isNotNull()), F.lit(-1))
    title = F.array_compact(F.array(blank_to_null(F.col("job")["title"])))
    return rows.filter("job.id <> ''").select("page_id", "place", F.col("job")["id"].alias("job_id"), title.alias("titles"), F.when(F.size("teams") > 0, label(team)).alias("team"), blank_to_null(F.col("job")["locationName"]).alias("location"), F.concat(F.lit(ASHBY_BOARD), "tenant", F.lit("/"), F.col("job")["id"]).alias("url"))


def generic(found: DataFrame, held: DataFrame, min_chars: int) -> DataFrame:
    """Any anchor outside an apply box whose address has the shape of a job's; its card is the list item, table row or element around it."""
    href, numbers = F.col("attrs")["href"], F.col("kind") == "greenhouse"
    job = F.when(numbers & _same_tenant(href), F.regexp_extract(href, NUMBERED, 1)).when(~numbers & F.contains(F.lower(href), F.lower("tenant")), F.regexp_extract(href, "/" + UUID, 1))
    links = found.filter((F.col("tag") == "a") & ~within("posting-apply")).withColumn("job_id", job).filter("job_id <> ''")
    rows = holding(links, held, F.coalesce("li", "tr", F.try_element_at("path", F.lit(-1)), "place"), "card")
    titles = candidates([], F.col("card"), F.struct("attrs", "inner"), F.col("above"), min_chars)
    return rows.select("page_id", "place", "job_id", titles.alias("titles"), F.lit(None).cast("string").alias("team"), F.col("card")["location"].alias("location"), href.alias("url"))


def entries(pages: DataFrame, found: DataFrame, min_chars: int = 3) -> DataFrame:
    """One row per page and job: place of its first card, titles (candidates of all its cards, in order, each once), and its first known team, location and address.

    pages: page_id, kind (greenhouse, lever, ashby), tenant, html; found: their elements. A page whose own template finds nothing is read by the generic one.
    """
    held = written(scopes(found))
    own = written(lever(found, held, min_chars).unionByName(greenhouse(found, held, min_chars)).unionByName(ashby(pages.filter("kind = 'ashby'"))))
    rest = found.join(own.select("page_id").distinct(), "page_id", "left_anti")
    rows = own.unionByName(generic(rest, held, min_chars))
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place")))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "titles"))), lambda x: x["titles"])
    return rows.groupBy("page_id", "job_id").agg(F.min("place").alias("place"), F.array_distinct(F.flatten(listed)).alias("titles"), known("team").alias("team"), known("location").alias("location"), known("url").alias("url"))


def titled(found: DataFrame, min_chars: int = 3) -> DataFrame:
    """Entries with title, their first candidate that is no junk, and why, the fault of the best candidate where there is none."""
    good = F.filter("titles", lambda t: junk_title(t, min_chars).isNull())
    title = F.get(good, F.lit(0))
    return found.withColumn("title", title).withColumn("why", F.when(title.isNull(), F.coalesce(junk_title(F.get("titles", F.lit(0)), min_chars), F.lit("no title"))))


def verdicts(pages: DataFrame, found: DataFrame, jobs: DataFrame, most_same: float = 0.60, least: int = 3) -> DataFrame:
    """page_id, entries, jobs (kept), declared and reasons (an empty array for a complete page) of every page.

    Reasons: no entries; junk titles; declares more jobs (cards of a lever page, stated totals of a greenhouse page); one title on more than most_same of at least least jobs, which drops all of them.
    """
    cards = found.filter((F.col("tag") == "div") & has("posting")).groupBy("page_id").agg(F.count(F.lit(1)).alias("cards"))
    declared = F.when(F.col("kind") == "lever", F.col("cards")).when(F.col("kind") == "greenhouse", declared_total("html"))
    same = jobs.withColumn("t", normalized_text("title")).groupBy("page_id", "t").agg(F.count(F.lit(1)).alias("n"), F.count("title").alias("named"))
    page = same.groupBy("page_id").agg(F.sum("n").alias("entries"), F.sum("named").alias("named"), F.max("named").alias("most"))
    rows = pages.join(cards, "page_id", "left").select("page_id", declared.cast("long").alias("declared")).join(page, "page_id", "left").na.fill(0, ["entries", "named", "most"])
    one = (F.col("named") >= least) & (ratio("most", "named") > most_same)
    why = [
        F.when(F.col("entries") == 0, "no entries"), F.when(F.col("entries") > F.col("named"), "junk titles"), F.when(F.col("declared") > F.col("entries"), "declares more jobs"), F.when(one, "dominant title"),
    ]
    return rows.select("page_id", "entries", F.when(one, 0).otherwise(F.col("named")).cast("long").alias("jobs"), "declared", F.array_compact(F.array(*why)).alias("reasons"))


def read(pages: DataFrame, min_chars: int = 3, most_same: float = 0.60, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """The jobs that captures keep (page_id, job_id, title, team, location, url) and the verdicts of all pages. Pages are parsed once and their elements written.

    Null and empty pages have no entries; a page_id must be unique. Jobs without a title are dropped, and all jobs of a page that one title dominates.
    """
    found = written(elements(pages))
    jobs = written(titled(entries(pages, found, min_chars), min_chars))
    pages_found = written(verdicts(pages, found, jobs, most_same, least))
    lost = pages_found.filter(F.array_contains("reasons", "dominant title")).select("page_id")
    return jobs.filter("title is not null").join(lost, "page_id", "left_anti").select("page_id", "job_id", "title", "team", "location", "url"), pages_found
