"""Boards by their templates, on literal pages of each kind."""

import json

import pytest

from larkspur.sources import templates as T

U = "00000000-0000-4000-8000-{:012d}".format


def lever_card(n, title, extra="", where="Berlin"):
    return f'<div class="posting" data-qa-posting-id="{U(n)}"><div class="posting-apply"><a href="https://jobs.lever.co/acme/{U(n)}">Apply</a></div><a class="posting-title" href="https://jobs.lever.co/acme/{U(n)}">{title}<div class="posting-categories"><span class="workplaceTypes">Remote &mdash; </span><span class="sort-by-location x">{where}</span></div></a>{extra}</div>'


LEVER = (
    '<html><body><div class="postings-group"><div class="large-category-header">Customer  Success</div><div class="posting-category-title">Services</div>' + lever_card(1, '<h5 data-qa="posting-name">Implementation &amp; Advisor</h5>') + "</div>"
    '<div class="postings-group">' + lever_card(2, "Plain Title") + '<div class="posting"><p>no id</p></div></div></body></html>'
)
GREENHOUSE = (
    '<h1>Jobs at Acme</h1><div class="job-posts--table--department"><h3 class="section-header x">IT</h3><table><tr class="job-post"><td><a href="https://job-boards.greenhouse.io/acme/jobs/11"><p class="body">Internal Auditor<span class="tag-container">New</span></p><p class="body--metadata">Remote - India</p></a></td></tr>'
    '<tr><td><a href="https://job-boards.greenhouse.io/other/jobs/12"><p>Not ours</p></a></td></tr></table></div><section><h3>Sales</h3><div class="opening"><a href="/acme/jobs/13?gh=1">Account Lead</a><span class="location">Paris</span></div></section>'
    '<script>{"jobPosts":{"count":2,"total":5}}</script>'
)
DATA = {"jobBoard": {"teams": [{"id": "t1", "name": "Inner", "externalName": " Public  Team "}, {"id": "t2", "name": "Two", "externalName": None}], "jobPostings": [{"id": U(1), "title": "Brace } Keeper {", "locationName": "Oslo", "teamId": "t1"}, {"id": U(2), "title": "Q\"uote", "locationName": None, "teamId": "t2"}, {"id": U(3), "title": "Apply", "teamId": "t9"}, {"title": "no id"}]}}
ASHBY = "<html><script>var a={};window.__appData = " + json.dumps(DATA) + ';if(x){y="}"}</script></html>'


@pytest.fixture(scope="module")
def read(spark):
    pages = [
        (1, "lever", "acme", LEVER), (2, "greenhouse", "acme", GREENHOUSE), (3, "ashby", "acme", ASHBY), (4, "ashby", "acme", "<script>window.__appData = {\"jobBoard\": {\"jobPostings\": [{\"id\": \"x\"</script>"), (5, "lever", "acme", None), (6, "lever", "acme", ""),
        # an older template: list items, a heading inside the card, attributes, and the heading above as the last resort
        (7, "lever", "acme", f'<h2>Teams</h2><ul><li><div><h4>Deep Heading</h4></div><a href="/acme/{U(1)}">Apply</a><i class=job-location>Rome</i><li><a aria-label="Said Aloud" href="/acme/{U(2)}">Apply</a><li><h3>Other Section</h3><li><a href="/acme/{U(3)}">Learn more</a><li><a href="/zzz/{U(4)}">Other</a></ul>'),
        (8, "lever", "acme", "".join(lever_card(n, "<h5>Same Role</h5>") for n in (1, 2, 3)) + lever_card(4, "Different")),
        (9, "greenhouse", "acme", '<p>An open paragraph<div><a href="/acme/jobs/1">Unclosed <b>Link<div><a href="/acme/jobs/2" title="Apply here">Second</div>'),
        (10, "lever", "acme", f'<div class="posting"><a href="/acme/{U(5)}/apply">x</a></div><div class="posting"><div class="posting-apply"><a href="/acme/{U(6)}">Apply</a></div><a href="/acme/{U(6)}?lever=1">From Its Address</a></div>'),
    ]
    jobs, found = T.read(spark.createDataFrame(pages, "page_id int, kind string, tenant string, html string"))
    rows = {}
    for r in jobs.collect():
        rows.setdefault(r.page_id, {})[r.job_id] = (r.title, r.team, r.location, r.url)
    return rows, {r.page_id: (r.entries, r.jobs, r.declared, r.reasons) for r in found.collect()}


def test_lever_cards_have_titles_teams_and_carried_departments(read):
    jobs, found = read
    url = "https://jobs.lever.co/acme/"
    assert jobs[1] == {U(1): ("Implementation & Advisor", "Services", "Berlin", url + U(1)), U(2): ("Plain Title", "Customer Success", "Berlin", url + U(2))}
    assert found[1] == (2, 2, 3, ["declares more jobs"])  # the card without an id
    assert jobs[10] == {U(6): ("From Its Address", None, None, f"/acme/{U(6)}?lever=1")}


def test_greenhouse_rows_keep_title_and_location_apart(read):
    jobs, found = read
    assert jobs[2] == {"11": ("Internal Auditor", "IT", "Remote - India", "https://job-boards.greenhouse.io/acme/jobs/11"), "13": ("Account Lead", "Sales", "Paris", "/acme/jobs/13?gh=1")}
    assert found[2] == (2, 2, 5, ["declares more jobs"])
    assert jobs[9] == {"1": ("Unclosed Link Second", None, None, "/acme/jobs/1"), "2": ("Second", None, None, "/acme/jobs/2")}


def test_ashby_data_is_cut_at_its_balanced_brace(read):
    jobs, found = read
    url = "https://jobs.ashbyhq.com/acme/"
    assert jobs[3] == {U(1): ("Brace } Keeper {", "Public Team", "Oslo", url + U(1)), U(2): ('Q"uote', "Two", None, url + U(2))}
    assert found[3] == (3, 2, None, ["junk titles"]) and found[4] == (0, 0, None, ["no entries"])


def test_unknown_templates_fall_back_to_anchors(read):
    jobs, found = read
    assert jobs[7] == {U(1): ("Deep Heading", None, "Rome", f"/acme/{U(1)}"), U(2): ("Said Aloud", None, None, f"/acme/{U(2)}"), U(3): ("Other Section", None, None, f"/acme/{U(3)}")}
    assert found[7] == (3, 3, None, []) and found[5] == found[6] == (0, 0, None, ["no entries"])


def test_one_title_for_most_jobs_drops_the_page(read):
    jobs, found = read
    assert 8 not in jobs and found[8] == (4, 0, 4, ["dominant title"])


def test_no_pages(spark):
    jobs, found = T.read(spark.createDataFrame([], "page_id int, kind string, tenant string, html string"))
    assert jobs.count() == 0 and found.count() == 0


def test_pages_are_parsed_in_batches(spark):
    """Elements go to Spark as whole Arrow batches, not as a frame a page; pages without elements and the largest ones keep their places."""
    rows = [(i, "lever", "t", LEVER if i % 3 else "<div>no element</div>") for i in range(9)] + [(9, "lever", "t", "<p>x</p>" * (2 * T.BATCH))]
    found = T.elements(spark.createDataFrame(rows, "page_id long, kind string, tenant string, html string"))
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    counts = {r.page_id: r["count"] for r in found.groupBy("page_id").count().collect()}
    assert counts[9] == 2 * T.BATCH and set(counts) == {1, 2, 4, 5, 7, 8, 9} and len({counts[i] for i in (1, 2, 4, 5, 7, 8)}) == 1
