"""Registrable domains, plausible ones, and the domain that a page's links give its owner."""

from pyspark.sql import functions as F

from larkspur.functions import domains as D


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_the_registrable_part_of_a_host(spark):
    cases = {"a.b.example.com": "example.com", "example.com": "example.com", "shop.example.co.uk": "example.co.uk", "co.uk": "co.uk", "localhost": None, "x.example.com.br": "example.com.br"}
    rows = spark.createDataFrame(list(cases.items()) + [(None, None)], "h string, want string")
    for r in rows.select("h", "want", D.registrable("h").alias("got")).collect():
        assert r.got == r.want, r.h


def test_which_domains_may_be_an_owners(spark):
    codes = D.country_codes(spark)
    assert {"de", "uk", "eu", "io"} <= set(codes) and "if" not in codes and all(len(c) == 2 for c in codes)
    cases = {"a.de": True, "you.if": False, "a.com": True, "a.c0m": False, "a.xn--p1ai": True, "a.xn--": False, "com": False, "": False, "a..com": False, ("x" * 64) + ".com": False, "a." + "b" * 25: False, None: False}
    rows = spark.createDataFrame(list(cases.items()), "d string, want boolean")
    for r in rows.select("d", "want", D.plausible("d", codes).alias("got")).collect():
        assert r.got == r.want, r.d


def test_a_domain_names_its_owner_by_letters_and_digits(spark):
    rows = spark.createDataFrame([("acme.com", "ACME, Inc.", None, True), ("acme-labs.io", "Acme", "x", True), ("foo.com", "Acme", "-", False), ("foo.com", None, None, False), ("foo.com", "bar", "foo-eu", True)], "d string, a string, b string, want boolean")
    for r in rows.select("d", "want", D.names_owner("d", "a", "b").alias("got")).collect():
        assert r.got == r.want, r.d


def test_owners_domains_are_mined_from_links(spark):
    a = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    pages = [
        (1, a("big.com", "big.com", "big.com", "www.acme.io"), "Acme", None, []),  # a name beats numbers
        (2, a("big.com", "big.com", "big.com", "big.com", "next.com", "next.com"), "Zed", "zed", []),  # four, and twice the next
        (3, a("big.com", "big.com", "big.com", "big.com", "next.com", "next.com", "next.com"), "Zed", None, []),
        (4, a("big.com", "big.com", "big.com"), "Zed", None, []),
        (5, a("a.vendor.com", "vendor.com", "x.gov", "b.mil", "you.if") * 4, "Vendor", None, []),  # none of these counts
        (6, None, "Zed", None, ["https://zed.co.uk/jobs"]),  # a link beside the page
        (7, a("acmetwo.com", "acme.com"), "Acme", None, None),  # equally often: the first one
        (8, '{"html":"<a href=\\"https://acme.org/\\">"}', None, "acme", []),  # escaped quotes
        (9, "", None, None, []),
        (10, a("big.com") * 4 + a("eq.com") * 4, "Zed", None, []),
    ]
    frame = spark.createDataFrame(pages, "page_id int, html string, company_name string, tenant string, urls array<string>")
    got = {r.page_id: (r.domain, r.found_by) for r in D.mined(frame, spark.createDataFrame([("vendor.com",)], "domain string"), urls="urls").collect()}
    none = (None, None)
    assert got == {1: ("acme.io", "name"), 2: ("big.com", "dominant"), 3: none, 4: none, 5: none, 6: ("zed.co.uk", "name"), 7: ("acmetwo.com", "name"), 8: ("acme.org", "name"), 9: none, 10: none}
    assert D.mined(frame.filter(F.lit(False)), spark.createDataFrame([], "domain string"), urls="urls").count() == 0
