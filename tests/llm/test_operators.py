import os
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import chat_format, components, exact_dedup, html_extract, jaccard_join, license_scan, mixing, quality_classifier, quality_rules, sentencepiece_fst, shingles, url_filter
from corvane.llm.catalog import GPT_PATTERN, URL_RULES, vocabulary

DOCS = "doc_id long, text string, lang string, source string, kept string, _id string"
ODD = [
    (1, "Some Text here", "en", "a", "x", "y"), (2, "some text HERE", "en", "b", "x", "y"), (3, None, None, None, None, None), (4, "", "en", "a", "x", "y"),
    (None, "no id", "en", "a", "x", "y"), (5, "É é", "fr", "b", "x", "y"), (6, "é é", "fr", "b", "x", "y"), (2, "some text HERE", "en", "b", "x", "y"),
    (7, "long " * 50_000, "en", "a", "x", "y"),
]


def frame(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS)


def test_exact_groups_ties_and_nulls(spark):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.assign(frame(spark)).collect()}
    assert (1, 2, 3, False) in got and (3, 4, 2, False) in got and (4, 4, 2, True) in got
    assert (5, 5, 1, True) in got and (6, 6, 1, True) in got and (None, None, 1, True) in got
    rows = exact_dedup.assign(frame(spark)).collect()
    assert len(rows) == len(ODD) and sum(r["kept"] for r in rows if r["doc_id"] == 2) == 1


def test_exact_compares_bytes(spark):
    """A hash that always collides still gives the groups of equal texts."""
    a = exact_dedup.assign(frame(spark), content_hash=lambda c: F.md5(F.length(c).cast("string"))).collect()
    b = exact_dedup.assign(frame(spark)).collect()
    key = lambda r: (str(r["doc_id"]), r["keep_id"] or -1, r["group_size"], r["text_sha256"])
    assert sorted(map(key, a)) == sorted(map(key, b))


def test_exact_stage_keeps_columns_and_empty_table(spark):
    kept = exact_dedup.deduplicate(frame(spark))
    assert kept.columns == ["doc_id", "text", "lang", "source", "kept", "_id"]
    assert sorted(str(r[0]) for r in kept.select("doc_id").collect()) == sorted(["2", "4", "None", "5", "6", "7"])
    assert exact_dedup.assign(frame(spark, [])).count() == 0


def test_mixing_targets_and_taken(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 40), "en", f"s{min(3, rng.randint(0, 9))}", "x", "y") for i in range(600)] + ODD
    docs = frame(spark, rows)
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        t = by.setdefault((r["source_size"], r["target"]), [0, 0])
        t[0] += r["taken"]
    total = sum(r["size"] for r in got)
    assert abs(sum(t for _, t in by) - total) < 1e-3 * total
    for (size, target), (taken, _) in by.items():
        assert target <= 3 * size + 1e-6
        if size < 10_000:
            assert abs(taken - target) <= max(25, 0.02 * target), (size, target, taken)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.plan(docs).collect()), key=repr)
    mixed = mixing.mix(docs)
    words = mixed.select(F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).alias("n")).agg(F.sum("n")).first()[0]
    assert words == sum(r["taken"] for r in got) and mixed.columns == docs.columns


def test_mixing_unequal_probabilities(spark):
    """Expected words equal the target, long documents are likelier, certain ones are taken, and no table or one source are fine."""
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([3, 30, 2000]), "en", f"s{i % 3}", "x", "y") for i in range(3000)]
    docs = frame(spark, rows)
    keyed, src, _, _ = mixing.decide(mixing.sizes(docs))
    p = keyed.join(src.select("_k", "_lambda", (F.col("_f") * F.col("_ssize")).alias("_due")), "_k").withColumn("_p", F.least(F.lit(1.0), F.col("_lambda") * mixing.weight_of(F.col("_size"))))
    for r in p.groupBy("_k").agg(F.sum(F.col("_p") * F.col("_size")).alias("w"), F.first("_due").alias("t")).collect():
        assert abs(r["w"] - r["t"]) < 1e-6 * max(1, r["t"])
    taken = p.join(mixing.plan(docs).select(F.col("doc_id").alias("_id"), "taken"), "_id").join(src.select("_k", "_copies"), "_k").withColumn("more", F.col("taken") / F.col("_size") - F.col("_copies"))
    assert taken.filter("_p >= 1 and more < 1").count() == 0
    share = {r["_size"]: r["m"] for r in taken.filter("_p < 1 and _p > 0").groupBy("_size").agg(F.avg("more").alias("m")).collect()}
    assert share[3] < share[2000]
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
    one = mixing.plan(docs.withColumn("source", F.lit(None).cast("string"))).agg(F.sum("taken"), F.max("target")).first()
    assert one[0] == one[1]
    even = mixing.plan(docs, favour_long=False).agg(F.sum("taken")).first()[0]
    assert abs(even - one[1]) < 0.02 * one[1]


def test_mixing_of_sources_with_heavy_tails(spark):
    """Every source of few documents of very unequal sizes comes as near its target as whole documents allow, within a tenth of it."""
    rng = random.Random(4)
    rows = [(100 * k + i, "w " * max(1, int(20 * rng.paretovariate(0.8))), "en", f"s{k:02d}", "x", "y") for k in range(24) for i in range(20)]
    by = {}
    for r in mixing.plan(frame(spark, rows)).collect():
        t = by.setdefault(r["doc_id"] // 100, [r["target"], 0, []])
        t[1] += r["taken"]
        t[2].append(r["size"])
        assert r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"]
    for target, taken, sizes in by.values():
        # all sums of whole documents, as bits
        copies = int(target / sum(sizes))
        sums = 1
        for n in sizes:
            sums |= sums << n
        due = target - copies * sum(sizes)
        best = min(abs(due - x) for x in range(sum(sizes) + 1) if sums >> x & 1)
        assert abs(taken - target) <= best + 0.1 * target


def _words(rng, n):
    return [rng.choice("abcdefgh") + rng.choice("klmnop") + str(rng.randint(0, 60)) for _ in range(n)]


def _corpus(seed=3):
    rng = random.Random(seed)
    shared = " ".join(_words(rng, 30))
    docs = []
    for _ in range(12):
        base = _words(rng, rng.choice([1, 3, 5, 9, 40, 90]))
        for _ in range(rng.randint(1, 30)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice("xyz") + str(rng.randint(0, 10**6))
            docs.append(" ".join(w) + (" " + shared if rng.random() < 0.3 else ""))
    return [(i, t) for i, t in enumerate(docs)] + [(len(docs), ""), (len(docs) + 1, None), (len(docs) + 2, docs[0].upper())]


def _brute(rows):
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("rare", [64, 2])
def test_jaccard_equals_brute_force(spark, rare):
    """With few tokens in the frequent class and with most, and in blocks of a few rows."""
    rows = _corpus()
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rare_most=rare, block_bytes=3000 if rare == 2 else jaccard_join.BLOCK_BYTES).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == _brute(rows)


def test_index_keys_meet_for_every_similar_pair():
    """Any two sets of similarity 0.75 or more share an index key with room enough, whatever tokens are frequent."""
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop = rng.random(len(x)) < rng.random() * 0.25
        y = np.unique(np.concatenate([x[~drop], rng.integers(0, 2**63, int(rng.integers(0, len(x) // 6 + 1))).astype(np.uint64)]))
        if not len(y) or 100 * len(np.intersect1d(x, y)) < 75 * len(np.union1d(x, y)):
            continue
        # shared tokens occur twice or more, others once or more; the same count in both sets
        counts = {t: int(rng.choice([1, 2, 3, 80, 90]) if t not in y or t not in x else rng.choice([2, 3, 70, 80])) for t in np.union1d(x, y).tolist()}
        entries = []
        for s in (x, y):
            kept = np.array([t for t in s.tolist() if counts[t] > 1], np.uint64)
            keys, rooms = jaccard_join.index_keys(kept, np.array([counts[t] for t in kept.tolist()], np.int64), len(s), 75, 100)
            entries.append(dict(zip(keys.tolist(), rooms.tolist(), strict=True)))
        a, b = entries
        assert any(min(a[k], b[k]) * 175 >= 75 * (len(x) + len(y)) for k in a.keys() & b.keys())


def test_jaccard_odd_rows(spark):
    """NULL and repeated ids, one id with two texts, clashing columns, a long text in blocks, an empty table."""
    long = " ".join(f"w{i}" for i in range(60_000))
    t, other = "one two three four five six seven", "quite another text of some seven words"
    rows = [(1, t, "a"), (2, t, "b"), (2, other, "c"), (2, other, "d"), (None, t, "e"), (None, "no id has these words here", "f"), (3, long, "g"), (4, long + " end", "h"), (5, " \n", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string").withColumn("_class", F.lit(1)).withColumn("id", F.lit("x"))
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df, block_bytes=1000).collect()}
    assert got == {(1, 3, 1), (2, 3, 1), (2, 3, 2), (None, 3, 1), (None, 2, None), (3, 59996, 3), (4, 59997, 3), (5, 0, 5)}
    kept = jaccard_join.representatives(df)
    assert kept.columns == df.columns and sorted(r["n"] for r in kept.collect() if r["n"] not in ("c", "d")) == ["a", "f", "g", "i"] and kept.filter("doc_id = 2").count() == 1
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0 and jaccard_join.representatives(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 105), (7, 300)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got[40] == 1 and got[300] == 1 and got[105] == 100 and got[1] == 1
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


PAGE = """<html><body><header>Site</header><nav><a>Home</a></nav><div class="cookie-notice">We use cookies</div><main><article><h1>Title &amp; more</h1>
<p>First  <b>para</b>
graph<br>two<p>Second &lt;x&gt;<div class="wrap"><p>Third {n}</p></div><div><span>Share this page now</span></div><script>var x = "<p>no</p>";</script>
<ul><li>one<li>two</ul><form><p>mail</p></form><section id="comments"><p>Nice</p></section></article></main><aside>More</aside><footer>End</footer>"""


def test_html_text_and_template(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.replace("{n}", str(i))) for i in range(8)] + [(90, None, None), (91, "x", ""), (92, "http://o.example/", "<p>Only &copy; this<p>and that")]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3]["text"] == "Title & more\n\nFirst para graph two\n\nSecond <x>\n\nThird 3\n\none\n\ntwo"
    assert got[90]["text"] == "" and got[91]["text"] == "" and got[92]["text"] == "Only © this\n\nand that"
    assert got[3]["n_chars"] == len(got[3]["text"]) and got[3]["n_template"] > 0


def test_html_template_of_a_large_host(spark):
    """A box on 110 different pages of 6,000 is template; 110 copies of one page are not."""
    page = "<body><article><p>Text {}</p>{}</article></body>"
    rows = [(i, f"http://h.example/{i}", page.format(i, "<div>Our offer</div>" if i < 110 else "")) for i in range(5890)]
    rows += [(i, f"http://h.example/{i}", page.format("copy", "<div>Own words</div>")) for i in range(5890, 6000)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[5] == "Text 5" and got[500] == "Text 500" and got[5900] == "Text copy\n\nOwn words"


def _site(i, rng):
    """A page whose boilerplate has neutral names, and its text."""
    own = [f"Text {i} " + " ".join(_words(rng, 12)) for _ in range(6)]
    items = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in _words(rng, rng.randint(3, 7)))
    box = f"<div class='k7'><span>Our offer of the week</span> number {i}</div>"
    page = f"<body><div class='x1'><ul>{items}</ul></div>{box}<div class='c'><article><h1>{own[0]}</h1><p>{own[1]}</p><p>{own[2]}</p><div class='k8'>Read more of us</div><p>{own[3]}</p><p>{own[4]}</p><p>{own[5]}</p><p>All texts are from our desk.</p></article></div><section>Desk address, house 4</section></body>"
    return page, "\n\n".join(own)


def test_html_template_decides_without_names(spark):
    """Menus with changing items, numbered boxes, boxes and edge notices inside an article go by their counts alone."""
    rng = random.Random(1)
    pages = [_site(i, rng) for i in range(40)]
    shared = "<body><article><h1>{0}</h1><p>One passage that many pages share.</p><p>{1}</p><p>The same words here and there.</p><p>{2}</p><p>One ending that all copies share.</p></article></body>"
    copies = [shared.format("Copied title", "body of the copies", f"changed {i}") for i in range(30)]
    rows = [(i, f"http://h.example/{i}", p) for i, (p, _) in enumerate(pages)] + [(100 + i, f"http://c.example/{i}", c) for i, c in enumerate(copies)] + [(200 + i, f"http://c.example/o{i}", shared.format(f"t{i}", f"u{i}", f"v{i}").replace("that many", f"{i}").replace("all copies", f"{i}")) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df.withColumn("text", F.lit(1)).withColumn("_r", F.lit(2))).collect()}
    assert all(got[i] == text for i, (_, text) in enumerate(pages))
    assert all("One passage that many" in got[100 + i] and "all copies share" in got[100 + i] for i in range(30))
    off = {r["page_id"]: r["text"] for r in html_extract.extract(df, least_pages=10**6).collect()}
    assert all(x in off[3] for x in ("Read more", "our desk")) and off[100] == got[100]
    body = df.withColumn("html", F.regexp_replace("html", "</?article>", "")).filter("page_id < 40")
    on, off = ({r["page_id"]: r["text"] for r in html_extract.extract(body, least_pages=n).collect()} for n in (5, 10**6))
    assert "Our offer" in off[3] and "Desk address" in off[3] and off[3].count("\n\n") > on[3].count("\n\n") + 5
    assert all(x not in on[3] for x in ("Our offer", "Desk address")) and pages[3][1].split("\n\n")[1] in on[3]


def test_html_counts_equal_brute_force(spark):
    """The template of every host by the definition, from all pages at once."""
    rng = random.Random(7)
    rows = [(i, f"http://h{i % 3}.example/{i}", _site(i % 50, rng)[0]) for i in range(90)] + [(0, "http://h0.example/0", "<p>again</p>")] * 2 + [(500, None, None)]
    hosts, seen = {}, {}
    for r in set(rows):
        host = (r[1] or "").split("/")[2] if r[1] else ""
        hosts[host] = hosts.get(host, 0) + 1
    for r in rows:
        host = (r[1] or "").split("/")[2] if r[1] else ""
        for h, beside in html_extract.hash_tree(html_extract.parse(r[2])) if r[2] else ():
            seen.setdefault((host, h, beside != 0), []).append(beside or r[2])
    gone = set()
    for (host, h, edge), of in seen.items():
        often = (len(of) >= 0.5 * hosts[host] and len(set(of)) >= 0.5 * len(of)) if edge else (len(of) >= 0.02 * hosts[host] or len(set(of)) >= 100)
        if len(set(of)) >= 5 and often:
            gone.add((host, h))
    want = sorted((r[0], html_extract.main_text(r[2], frozenset(h for x, h in gone if x == ((r[1] or "").split("/")[2] if r[1] else "")))) for r in rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((r["page_id"], r["text"]) for r in html_extract.extract(df).collect()) == want and len(gone) > 5
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_reads_whole_articles_and_broken_markup():
    text = html_extract.main_text
    assert text("<article><p title=it's>Text here</p><p>More</p></article>") == "Text here\n\nMore"
    assert text("<article><div class='search-results'><p>Body text</p></div><p class='intro-share'>Own</p><p class=related>Kin</p><p class='ad'>Buy</p><div class='share-buttons'>S</div></article>") == "Body text\n\nOwn\n\nKin"
    assert text("<main>a<article><p>b</article>c<article><p>d</article></main><article>e</article><aside><article>no</article></aside>") == "a\n\nb\n\nc\n\nd\n\ne"
    assert text("<p>a < b &amp; c<p>d") == "a < b & c\n\nd" and text("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n\n2\n\n3" and text("x<p y='") == "x"
    assert text("<ul><li>a<ul><li>b</ul><li>c</ul></i></b>d") == "a\n\nb\n\nc\n\nd" and text("<a title='x > y'>z</a><br/>w") == "z w"


@pytest.mark.parametrize("bad", ["<p x", "<a '", "<b>", "<li>", "<b><div></b>", "<!--", "<script>", "<", "<a b=\"c ", "<table><tr><td>"])
def test_html_hostile_page_takes_linear_time(bad):
    import time

    def seconds(n):
        began = time.process_time()
        html_extract.main_text(bad * (n // len(bad)), frozenset([1]))
        return time.process_time() - began

    assert seconds(1 << 20) < 30 and seconds(1 << 19) < 20


def test_url_rules(spark):
    urls = ["http://A.example.com/en/1?x", "https://www.example.com/en/1", "http://x.net/es/2", "http://x.net/de/2", "http://notcom/", None, "nothing", "http://example.com", "http://b.example.com/fr/1#t"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(3, 1)], "page_id long, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, labels, URL_RULES).collect()}
    assert got[0] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[1][2:] == ("www.example.com/en/", "allow") and got[2][2:] == ("net/es/", "block") and got[3][2] is None
    assert got[4][2] is None and got[5][:2] == ("", "") and got[6][:2] == ("", "") and got[7][2] is None and got[8][2:] == ("com/", "allow")


def test_url_template_purity(spark):
    pages = [(i, f"http://h.org/{'spam' if i % 2 else 'news'}/{i}") for i in range(200)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "page_id long, bad int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(df, labels, []).collect()}
    assert got[151] == "block" and got[150] == "allow" and len(got) == 200


def test_url_rare_bad_section_keeps_its_template(spark):
    """One bad section among 60 equal ones has under 2 % of its host's pages."""
    pages = [(i, f"http://h.org/s{i % 60}/{i}") for i in range(1800)]
    labels = spark.createDataFrame([(i, int(i % 60 == 7)) for i in range(1200)], "page_id long, bad int")
    got = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), labels, []).collect()}
    assert all((got[i]["verdict"] == "block") == (i % 60 == 7) for i in range(1800))
    assert got[7]["template"] == "/s7/<n>" and got[8]["template"] == "/*/<n>"


def _url_brute(pages, labels, z=1.96, siblings=20, share=0.02):
    """Verdicts without rules by the definition: the whole tree in Python."""
    import re

    def segment(x):
        m = re.search(r"(\.[A-Za-z]{1,5})$", x)
        suffix, stem = (m.group(1), x[: m.start()]) if m else ("", x)
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", stem):
            return "<date>" + suffix
        if re.fullmatch(r"\d+", stem):
            return "<n>" + suffix
        if re.fullmatch(r"(?=.*\d)[0-9a-fA-F-]{8,}", stem):
            return "<hex>" + suffix
        return re.sub(r"\d+$", "", stem) + "<n>" + suffix if re.search(r"\d{3,}$", stem) else x

    rows = []
    for i, u in pages:
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (m.group(1).lower(), m.group(2)) if m else ("", "")
        rows.append((i, host, [segment(x) for x in path.split("/") if x], labels.get(i)))
    template = {}

    def grow(group, prefix, level):
        """group: (id, typed segments, label); names the branches of one node of the tree."""
        kids = {}
        for r in group:
            kids.setdefault(r[1][level] if level < len(r[1]) else "", []).append(r)
        lab = lambda g: [r[2] for r in g if r[2] is not None]
        all_, named = lab(group), {}
        for k, g in kids.items():
            if len(kids) == 1 and len({tuple(r[1]) for r in g}) == 1:
                for r in g:
                    template[r[0]] = "/".join([*prefix, *r[1][level:]])
                return
            if k == "":
                for r in g:
                    template[r[0]] = "/".join(prefix)
                continue
            mine, pool = lab(g), sum(all_) / len(all_) if all_ else 0
            rare = len(kids) > siblings and len(g) < share * len(group)
            var = len(mine) * pool * (1 - pool)
            alike = len(kids) > 1 and mine and (var == 0 or abs(sum(mine) - len(mine) * pool) / var**0.5 <= z)
            named.setdefault("*" if rare and (alike or not mine) else "~" if alike else k, []).extend(g)
        for k, g in named.items():
            grow(g, [*prefix, k], level + 1)

    hosts = {}
    for i, host, seg, y in rows:
        hosts.setdefault(host, []).append((i, seg, y))
    known = [y for *_, y in rows if y is not None]
    overall, verdict = (sum(known) / len(known) if known else 0), {}
    for group in hosts.values():
        grow(group, [""], 0)
        mine = [y for *_, y in group if y is not None]
        prior = (sum(mine) + 50 * overall) / (len(mine) + 50)
        for t in {template[r[0]] for r in group}:
            of = [r for r in group if template[r[0]] == t]
            y = [r[2] for r in of if r[2] is not None]
            bad = (sum(y) + 10 * prior) / (len(y) + 10) >= min(0.5, 2 * overall) and sum(y) > 0 and sum(y) - len(y) * overall >= 1.645 * (len(y) * overall * (1 - overall)) ** 0.5
            verdict |= {r[0]: (t, "block" if bad else "allow") for r in of}
    return verdict


def test_url_filter_equals_brute_force(spark):
    rng = random.Random(17)
    pages, labels = [], {}
    for i in range(1500):
        host = rng.choice(["a.org", "b.org", "c.org"])
        section = rng.choice(["news", "shop", "spam", f"u{rng.randint(1, 60)}", ""])
        tail = rng.choice([f"/{i}", f"/{rng.choice(['x', 'y'])}/{i}.html", "/2024-01-02/t", f"/deadbeef0{i % 9}", "", "/a/b/c/d/e"])
        pages.append((i, rng.choice([f"http://{host}/{section}{tail}?q={i}", f"https://{host}//{section}{tail}#x"])))
        if rng.random() < 0.6:
            labels[i] = int(rng.random() < (0.8 if section == "spam" and host != "c.org" else 0.1))
    pages += [(2000, None), (2001, "no host"), (2002, "http://a.org")]
    want = _url_brute(pages, labels)
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit(1))
    got = {r["page_id"]: (r["template"], r["verdict"]) for r in url_filter.filter_urls(df, spark.createDataFrame(list(labels.items()), "page_id long, bad int"), []).collect()}
    assert got == want
    assert {v for _, v in got.values()} == {"allow", "block"}
    assert url_filter.filter_urls(df.limit(0), spark.createDataFrame([], "page_id long, bad int"), URL_RULES).count() == 0


def test_url_branches_split_below_the_third_segment(spark):
    deep = "a/" * 40
    pages = [(i, f"http://h.org/en/blog/2024/{('news', 'spam', 'x/y/bad', 'x/y/good')[i % 4]}/{i}") for i in range(400)] + [(1000, f"http://h.org/{deep}end"), (1001, "http://h.org/"), (1002, None)]
    labels = spark.createDataFrame([(i, int(i % 4 in (1, 2))) for i in range(200)], "page_id long, bad int")
    got = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), labels, []).collect()}
    assert len(got) == 403 and all((got[i]["verdict"] == "block") == (i % 4 in (1, 2)) for i in range(400))
    assert got[301]["template"].endswith("/spam/<n>") and got[1000]["template"].endswith("/a/a/end") and got[1001]["template"] == ""


def test_url_paths_of_many_shared_segments(spark):
    """A crawler trap: one host's pages share 1,000 segments, branch, and share 200 more."""
    deep, more = "t/" * 1000, "u/" * 200
    pages = [(i, f"http://h.org/{deep}{('news', 'spam')[i % 2]}/{more}{i}") for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "page_id long, bad int")
    began = time.time()
    got = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), labels, []).collect()}
    assert time.time() - began < 60
    assert len(got) == 300 and all((got[i]["verdict"] == "block") == bool(i % 2) for i in range(300))
    assert got[299]["template"] == f"/{deep}spam/{more}<n>"


def test_classifier_learns_and_handles_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(_words(rng, 60)) if i % 3 else " ".join(w + "***" for w in _words(rng, 60)), "en", "a", "x", "y") for i in range(300)]
    docs = frame(spark, rows + [(1000, None, None, None, None, None), (1001, "", "en", "a", "x", "y")])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300) if zlib.crc32(str(i).encode()) % 5], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, model).select("doc_id", "score").collect()}
    assert all((got[i] >= 0.3) == (i % 3 > 0) for i in range(300)) and 0 <= got[1000] <= 1 and got[1000] == got[1001]
    assert quality_classifier.train(docs, labels.limit(0)) == {"constant": 0.5}
    clash = quality_classifier.score(docs.withColumn("score", F.lit("x")), model)
    assert clash.columns == [*docs.columns, "score"] and clash.filter("score >= 0").count() == 302 and quality_classifier.score(docs.limit(0), model).count() == 0
    twice = docs.unionByName(docs.withColumn("text", F.reverse("text")))
    again = [quality_classifier.train(x, labels) for x in (twice, twice.orderBy(F.desc("text")))]
    assert np.array_equal(again[0]["w"], again[1]["w"])


def test_features_do_not_depend_on_segments():
    """Grams and words across a segment's end count, and no others."""
    rng = random.Random(5)
    flags = np.zeros(quality_classifier.SIZE, bool)
    for _ in range(60):
        text = "".join(rng.choice("aab  b.É\n") for _ in range(300)) + " one" * rng.randint(0, 9)
        whole = quality_classifier.features(text, flags)
        assert all(np.array_equal(whole, quality_classifier.features(text, flags, n)) for n in (1, 5, 40, 150))
    for k in (0, 5, 40_000):
        x = np.sort(np.array(rng.sample(range(quality_classifier.SIZE), k), np.int32))
        assert np.array_equal(np.frombuffer(quality_classifier._unpacked(quality_classifier._packed(x)), np.int32), x)


def test_transducer_equals_library():
    import sentencepiece

    model = sentencepiece_fst.load_model(vocabulary("piece_bpe_32k.model"))
    t, sp = sentencepiece_fst.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = ["Hello  world", "", " ", "  a b ", "a\nb\n\n c\t", "naïve façade 𝒳   你好世界", "x" * 500, "the " * 300, "internationalization's re-tokenisation!!! ***", "▁x ▁", "\x00\x01", "1,234.56 $%&"]
    rng = random.Random(4)
    texts += ["".join(rng.choice("abcdefghij THEthe\n.,*") for _ in range(200)) for _ in range(60)]
    for s in texts:
        assert t.encode(s) == sp.encode(s), s
        assert t.decode(t.encode(s)) == s.replace("▁", " ")
    assert t.encode(None) == []


def _unigram_model(fallback=True):
    """A small unigram model written by hand; nothing is trained."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = pb.TrainerSpec.UNIGRAM, fallback
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = "identity", True, False, True
    kinds = pb.ModelProto.SentencePiece
    m.pieces.add(piece="<unk>", score=0, type=kinds.UNKNOWN)
    m.pieces.add(piece="<s>", score=0, type=kinds.CONTROL)
    m.pieces.add(piece="</s>", score=0, type=kinds.CONTROL)
    for i in range(256):
        m.pieces.add(piece=f"<0x{i:02X}>", score=0, type=kinds.BYTE)
    rng = random.Random(8)
    words = {"▁", *"abcde", "▁a", "ab", "▁ab", "bc", "abc", "▁abc", "cd", "de", "cde", "ea", "▁b", "bcd", "aa", "▁▁"} | {"".join(rng.choice("abcde") for _ in range(rng.randint(2, 5))) for _ in range(40)}
    for w in sorted(words):
        m.pieces.add(piece=w, score=-rng.uniform(1, 9) - len(w) / 7, type=kinds.NORMAL)
    return m.SerializeToString()


@pytest.mark.parametrize("text", ["".join(chr(0x4E00 + i * 37 % 5000) for i in range(330_000)), "0123456789" * 100_000, "é" * 500_000], ids=["chinese", "digits", "accents"])
def test_texts_that_fall_apart_take_linear_time(text):
    """A million bytes without a space, whose characters no piece spans."""
    import sentencepiece

    model = sentencepiece_fst.load_model(vocabulary("piece_bpe_32k.model"))
    t, sp = sentencepiece_fst.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    began = time.process_time()
    got = t.encode(text)
    assert time.process_time() - began < 5
    assert got == sp.encode(text)


def test_unigram_transducer_equals_library_and_every_path():
    import itertools

    import sentencepiece

    model = _unigram_model()
    t, sp = sentencepiece_fst.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(6)
    for _ in range(300):
        s = "".join(rng.choice("abcde abcde zé\n") for _ in range(rng.randint(1, 40)))
        assert t.encode(s) == sp.encode(s), s
        assert t.decode(t.encode(s)) == s
    for _ in range(40):  # the least weight of all ways to cut a short text
        s = sentencepiece_fst.MARK + "".join(rng.choice("abcde") for _ in range(8))
        ways = []
        for cuts in itertools.product((0, 1), repeat=len(s) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(s)]
            parts = [s[a:b] for a, b in zip(at, at[1:], strict=False)]
            if all(x in t.ids for x in parts):
                ways.append(-sum(t.score[t.ids[x]] for x in parts))
        assert abs(min(ways) + sum(t.score[i] for i in t.encode(s[1:]))) < 1e-4


def test_merge_path_agrees_with_neighbours_only():
    """Every finite path of the merge machine is the library's; bounded tables do not change results."""
    import sentencepiece

    model = sentencepiece_fst.load_model(vocabulary("piece_bpe_32k.model"))
    t, sp = sentencepiece_fst.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    t._words.most = t._runs.most = 4000
    rng = random.Random(11)
    for _ in range(150):
        s = "".join(rng.choice(["in", "ter", "nation", "al", "iz", "e", " ", "  ", "\n", "é", "ß", "日", "0", "x", "☃"]) for _ in range(60))
        assert t.encode(s) == sp.encode(s), s


def test_tasks_of_other_operators_drop_the_transducer():
    import gc
    import weakref

    from corvane.llm import common

    model = sentencepiece_fst.load_model(vocabulary("piece_bpe_32k.model"))
    alive = weakref.ref(sentencepiece_fst.compiled(model))
    assert list(common.lean(iter, "sentencepiece")([1, 2])) == [1, 2]
    assert alive() is not None and sentencepiece_fst.compiled(model) is alive()
    gc.disable()  # the drop itself must free the tables
    try:
        assert list(common.lean(iter)([3])) == [3]
        assert alive() is None
    finally:
        gc.enable()
    assert sentencepiece_fst.compiled(model).encode("a b")


def test_encode_and_decode_frames(spark):
    model = sentencepiece_fst.load_model(vocabulary("piece_bpe_32k.model"))
    docs = frame(spark)
    coded = sentencepiece_fst.encode(docs, model, keep=["doc_id"])
    assert coded.filter("not roundtrip").count() == 0 and coded.count() == len(ODD)
    back = sorted(r["text"] for r in sentencepiece_fst.decode(coded, model).collect())
    assert back == sorted(r[1] or "" for r in ODD)
    clash = docs.withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    got = sentencepiece_fst.encode(clash, model)
    assert got.columns == ["doc_id", "text", "lang", "source", "kept", "_id", *sentencepiece_fst.RESULTS] and got.count() == len(ODD)
    assert sentencepiece_fst.encode(docs.limit(0), model).count() == 0 and sentencepiece_fst.decode(coded.limit(0), model).count() == 0


def _rules(docs, **more):
    with open(vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    model = sentencepiece_fst.load_model(vocabulary("piece_bpe_32k.model"))
    return quality_rules.judge(docs, model, ranks, GPT_PATTERN, **more)


def test_rules_counts(spark):
    text = "a b c a b c x\n#one\n#one\n\n"
    rows = [(1, text, "en", "a", "x", "y"), (2, None, None, "a", "x", "y"), (3, "word " * 100, "en", "a", "x", "y"), (4, " ".join(f"w{i}" for i in range(200)), "xx", "a", "x", "y"), (5, "x" * 300_000 + " y" * 60, None, "a", "x", "y")]
    docs = frame(spark, rows + rows[:1]).withColumn("band", F.lit(1))
    found = _rules(docs).collect()
    got = {r["doc_id"]: r for r in found}
    assert len(found) == 6
    assert (got[1]["n_words"], got[1]["word_chars"], got[1]["n_symbols"], got[1]["n_dup_lines"], got[1]["n_repeat_words"]) == (9, 15, 2, 1, 6)
    assert got[2]["n_words"] == 0 and got[2]["base_failed"] and not got[2]["kept"]
    assert got[3]["base_failed"] and not got[4]["base_failed"] and got[4]["band"] == "fixed Latin" and got[5]["n_words"] == 61 and got[5]["word_chars"] == 300_060
    assert _rules(docs.limit(0)).count() == 0


def test_fertility_equals_both_libraries():
    """Words encoded together, and odd words, give the tokens of words encoded one by one."""
    with open(vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        fert = quality_rules.Fertility(sentencepiece_fst.load_model(vocabulary("piece_bpe_32k.model")), f.read(), GPT_PATTERN)
    for words in (["Hello", "a.b's", "%%%x", "日本", "naïve", "12,5", "x" * 900], ["\u00a0x", "a\u00a0", "\u2003", "ok"], ["w"], []):
        fert.learn(set(words))
        codes = fert.codes(words)
        ids = [fert.sp.encode(w) for w in words], [fert.enc.encode_ordinary(" " + w) for w in words]
        got = fert.measure(codes, 100)
        for v, lists in enumerate(ids):
            flat = [i for x in lists for i in x]
            assert not flat or abs(got[3 * v] - 100 / len(flat)) < 1e-12 and abs(got[3 * v + 1] - sum(bool(fert.byte[v][i]) for i in flat) / len(flat)) < 1e-12
        assert got[6] == sum(map(len, ids[0]))


def test_rules_script_of_the_whole_text():
    """A Latin opening of 200 words does not decide for a text that goes on in another script, nor the reverse."""
    latin = [f"Wort{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(200)]
    other = ["".join(chr(0x4E00 + (i * 7 + j * 131) % 4000) for j in range(6)) for i in range(900)]
    texts = [" ".join(latin + other), " ".join(other[:200] + latin * 2), " ".join(latin), "1 2 3"]
    assert [quality_rules.script_of(t) for t in texts] == ["Other", "Latin", "Latin", "Latin"]


def test_rules_bands_equal_brute_force(spark):
    """Damaged texts of a language go, others stay; fences by sorting all values in Python."""
    rng = random.Random(12)
    rows = []
    for i in range(420):
        words = _words(rng, rng.randint(60, 400))
        if i % 20 == 7:
            words = [w + rng.choice(["%%%", "###", "$$$"]) for w in words]
        rows.append((i, " ".join(words), ["en", "de", None][i % 3], "a", "x", "y"))
    rows += [(1000, " ".join(_words(rng, 300)), "rare", "a", "x", "y")]
    got = {r["doc_id"]: r for r in _rules(frame(spark, rows), least_group=20).collect()}
    values = {i: ([got[i][m] for m in quality_rules.MEASURES], (r[2] or "", got[i]["n_tokens"].bit_length()), got[i]["base_failed"] or got[i]["n_tokens"] < 100) for i, r in ((r[0], r) for r in rows)}
    for i, (own, group, out) in values.items():
        if out:
            assert got[i]["kept"] == (not got[i]["base_failed"])
            continue
        for members in ([v for v, g, o in values.values() if g == group and not o], [v for v, g, o in values.values() if not o]):
            if len(members) >= 20:
                break
        reason = None
        for m in range(6):
            bins = sorted(int(np.floor(v[m] * 1000)) for v in members)
            q1, q3 = bins[-(-len(bins) // 4) - 1], bins[-(-3 * len(bins) // 4) - 1]
            share, least = quality_rules.FLOORS[m]
            spread = max(q3 - q1, q1 * share, least * 1000)
            low, high = quality_rules.SIDES[m]
            if reason is None and ((low and own[m] < (q1 - 2.5 * spread) / 1000) or (high and own[m] > (q3 + 1 + 2.5 * spread) / 1000)):
                reason = quality_rules.MEASURES[m]
        assert (got[i]["rejected_by"], got[i]["kept"]) == (reason, reason is None), i
    bad = [i for i in range(420) if i % 20 == 7]
    assert sum(not got[i]["kept"] for i in bad) > 0.8 * len(bad) and sum(not got[i]["kept"] for i in range(420) if i not in bad) <= 4


def test_repeated_words_brute_force():
    rng = random.Random(9)
    for _ in range(200):
        w = [rng.randint(0, 3) for _ in range(rng.randint(0, 30))]
        seen = {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        want = {i + j for v in seen.values() if len(v) > 1 for i in v for j in range(3)}
        assert quality_rules.repeated_words(np.array(w, np.int64)) == len(want)


def test_licences(spark):
    s = license_scan.Scanner()
    assert s.scan("Text.\nLicensed under the Apache License, Version 2.0.\nMore")[0] == ["Apache-2.0"]
    wrapped = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
    assert s.scan(wrapped)[0] == ["MIT"]
    assert s.scan("We reserve that all rights reserved here are words")[0] == [] and s.scan(None) == ([], [])
    assert s.scan("All rights reserved.\nReleased under the MIT License.")[0] == ["Proprietary", "MIT"]
    got = license_scan.scan(frame(spark)).collect()
    assert len(got) == len(ODD) and all(r["verdict"] == "none" for r in got)


@pytest.mark.parametrize(
    "text, want",
    [
        ("SPDX-License-Identifier: BSD-2-Clause", ["BSD-2-Clause"]),
        ("// SPDX-License-Identifier: GPL-2.0-only", ["GPL-2.0"]),
        ("/* SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-or-later WITH Classpath-exception-2.0 */", ["MIT", "Apache-2.0", "GPL-2.0-or-later WITH Classpath-exception-2.0"]),
        ("Distributed under the MIT License", ["MIT"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/.", ["MPL-2.0"]),
        ("# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; either\n# version 2.1 of the License, or (at your option) any later version.", ["LGPL-2.1-or-later"]),
        ("Copyright (c) 2020, 2021 Jane Doe. All rights reserved.", ["Proprietary"]),
        ("some words\nAll rights reserved.\nmore words", ["Proprietary"]),
        ("words the licence of no one\nReleased under the terms of the ISC Licence\nand on", ["ISC"]),
        ("We reserve that all rights reserved here are words", []),
        ("under the weather", []),
        ("Text under CC BY 4.0; code under the new BSD license.", ["CC-BY-4.0", "BSD-3-Clause"]),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ["BSD-2-Clause"]),
    ],
)
def test_licence_notices(text, want):
    assert license_scan.Scanner().scan(text)[0] == want


@pytest.mark.parametrize(
    ("text", "want", "verdict"),
    [
        ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", ["Apache-2.0", "MIT"], "permissive"),
        ("This crate is dual licensed under the MIT and Apache 2.0 licenses.", ["MIT", "Apache-2.0"], "permissive"),
        ("Dual licensed under GPLv3 and the MIT license", ["GPL-3.0", "MIT"], "permissive"),
        ("Released under the MIT license and the GPL-2.0", ["MIT", "GPL-2.0"], "restricted"),
        ("This is not licensed under the MIT License.", [], "none"),
        ("It isn't released under the MIT License. It is released under the ISC license.", ["ISC"], "permissive"),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", ["GPL-2.0 WITH Classpath-exception-2.0"], "restricted"),
        ("// SPDX-License-Identifier: 0BSD", ["0BSD"], "restricted"),
        ("SPDX-License-Identifier: GPL-2.0 OR MIT", ["GPL-2.0", "MIT"], "permissive"),
        ("SPDX-License-Identifier: GPL-2.0 AND MIT", ["GPL-2.0", "MIT"], "restricted"),
        ("SPDX-License-Identifier: (GPL-2.0-or-later OR MIT) AND Apache-2.0", ["GPL-2.0-or-later", "MIT", "Apache-2.0"], "permissive"),
        ("SPDX-License-Identifier: MIT AND (GPL-3.0+ OR (Zlib AND LGPL-2.1-only))", ["MIT", "GPL-3.0-or-later", "Zlib", "LGPL-2.1"], "restricted"),
    ],
)
def test_licence_expressions_and_coordinated_names(text, want, verdict):
    found, _, said = license_scan.Scanner().judge(text)
    assert (found, said) == (want, verdict)


def test_licence_scan_of_an_empty_table(spark):
    assert license_scan.scan(frame(spark, [])).count() == 0


def test_licence_rules_equal_brute_force():
    """Chains of random identifiers by the definition: rules in order, from the left, each sentence used once."""
    rng = random.Random(13)
    sentences = {x: [f"{x} permission sentence"] for x in "abcd"}
    rules = [("ABC", ["a", "b", "c"]), ("AB", ["a", "b"]), ("DD", ["d", "d"]), ("A", ["a"]), ("C", ["c"])]
    scanner = license_scan.Scanner(sentences, rules, gap=60)
    for _ in range(300):
        text = "".join(f"{rng.choice('abcd')} permission sentence. " + "filler " * rng.choice([0, 0, 3, 12]) for _ in range(rng.randint(0, 12)))
        got, known = scanner.scan(text)
        used, want = set(), []
        for name, ids in rules:
            for i in range(len(known)):
                if i in used or known[i][2] != ids[0]:
                    continue
                at = [i]
                for x in ids[1:]:
                    nxt = next((j for j in range(at[-1] + 1, len(known)) if j not in used and known[j][2] == x), None)
                    if nxt is None or known[nxt][0] - known[at[-1]][1] > 60:
                        break
                    at.append(nxt)
                if len(at) == len(ids):
                    used |= set(at)
                    want.append((known[i][0], at[0], name))
        assert got == [x for _, _, x in sorted(want)]


@pytest.mark.parametrize("text", ["Released under the MIT License.\n" * 100_000, "all rights reserved " * 100_000, "licensed under " * 70_000, "permission is hereby\n" * 50_000])
def test_licence_scan_takes_linear_time(text):
    import time

    began = time.process_time()
    license_scan.Scanner().scan(text)
    assert time.process_time() - began < 15


def test_chat_round_trip(spark):
    assert all(chat_format.unescape(chat_format.escape(x)) == x for x in ["\\### Assistant: </turn> ok", "#### User:", "\\\\</turn>", "a\\", ""])
    rows = [(1, 1, "assistant", "Hi </turn>"), (1, 0, "user", None), (2, 0, "tool </turn>", "é\\"), (2, 1, None, "x"), (None, 0, "assistant", "z"), (1, 1, "assistant", "Hi </turn>")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    with open(vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.assemble(chat_format.encoded_turns(turns, ranks, GPT_PATTERN)), ranks, GPT_PATTERN).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 20 and got[2]["loss_chars"] == 0 and got[None]["loss_chars"] == 1
    import hashlib

    assert got[2]["turns_sha256"] == hashlib.sha256("tool </turn>\né\\\n\nx\n".encode()).hexdigest()


def test_chat_of_a_long_conversation_and_odd_tables(spark):
    """Offsets of 20,000 turns over range partitions, a long text, columns of the operator's names, no row."""
    with open(vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    n = 20_000
    turns = spark.range(n).select(
        F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.when(F.col("id") == 7, F.repeat(F.lit("long "), 60_000)).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"),
        F.lit("x").alias("conv"), F.lit("y").alias("ids"), F.lit("z").alias("key"), F.lit("w").alias("_row"),
    )
    encoded = chat_format.encoded_turns(turns.repartition(4), ranks, GPT_PATTERN)
    spans = chat_format.assemble(encoded)
    rows = sorted(spans.select("place", "start", "mask_from", "mask_to", F.size("ids").alias("n")).collect())
    at = 0
    for i, r in enumerate(rows):
        assert (r["place"], r["start"]) == (i, at) and (r["mask_to"] > r["mask_from"]) == (i % 2 == 1)
        at += r["n"]
    (got,) = chat_format.read_back(spans, ranks, GPT_PATTERN).collect()
    texts = ["long " * 60_000 if i == 7 else f"t{i}" for i in range(n)]
    assert got["n_turns"] == n and got["loss_chars"] == sum(len(t) for t in texts[1::2])
    assert chat_format.read_back(chat_format.assemble(chat_format.encoded_turns(turns.limit(0), ranks, GPT_PATTERN)), ranks, GPT_PATTERN).count() == 0


def test_vocabulary_is_not_in_the_repository():
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert not vocabulary("x").startswith(here)
