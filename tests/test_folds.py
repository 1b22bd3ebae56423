"""Distributed rules against small sequential ones on random input."""

import random

from pyspark.sql import functions as F

from proofloom.operators import catalog as C
from proofloom.operators import references as X
from proofloom.operators.prefix import first_rows, number_rows, pack_batches, running_totals, trailing_rows

PAPER = ("seq bigint, title string, authors array<string>, year int, abstract string, doi string, venue string, "
         "citation_count int, open_access_pdf_url string, source_api string, pmcid string, arxiv_id string, "
         "full_text_available boolean, full_text_content string, acquisition_method string")


def random_papers(rng, n):
    titles = [f"A sufficiently long title number {i} of a study" for i in range(6)] + ["Short one", "Editorial", ""]
    rows = []
    for seq in range(n):
        full = rng.random() < 0.3
        rows.append((seq, rng.choice(titles), ["A B"], 2000, rng.choice([None, "", "x" * rng.randint(1, 5)]),
                     rng.choice([None, "", "10.1/a", "10.1/B ", "10.1/b", "10.1/c", "10.1/d"]), "V", rng.choice([None, 0, 3, 9]),
                     rng.choice([None, "", f"u{seq}"]), "api", rng.choice([None, f"P{seq}"]), None, full,
                     f"text {seq}" if full else None, "m" if full else None))
    return rows


def sequential_catalog(rows):
    """Records in arrival order, each tested by DOI, identity and title."""
    import hashlib
    import re
    store, by_doi, by_title = {}, {}, {}
    for r in rows:
        seq, title, abstract, doi, cites, pdf, pmc, full, text = r[0], r[1], r[4], r[5], r[7], r[8], r[10], r[12], r[13]
        key = (doi or "").strip().lower()
        pid = "doi:" + key if doi else "hash:" + hashlib.md5(title.lower().strip().encode()).hexdigest()[:12]
        tkey = re.sub("[^a-z0-9]+", " ", title.lower()).strip()
        target = None
        if key and key in by_doi:
            target = by_doi[key]
        elif pid in store:
            continue
        elif len(tkey) >= 25 and tkey in by_title:
            target = by_title[tkey]
            if key:
                by_doi[key] = target
        if target is None:
            store[pid] = dict(seq=seq, abstract=abstract, cites=cites, pdf=pdf, pmc=pmc, full=full, text=text)
            if key:
                by_doi[key] = pid
            if len(tkey) >= 25:
                by_title[tkey] = pid
            continue
        kept = store[target]
        if abstract and len(abstract) > len(kept["abstract"] or ""):
            kept["abstract"] = abstract
        if cites and cites > (kept["cites"] or 0):
            kept["cites"] = cites
        kept["pdf"] = kept["pdf"] or pdf or kept["pdf"]
        kept["pmc"] = kept["pmc"] or pmc
        if full and not kept["full"]:
            kept["full"], kept["text"] = True, text
    return sorted((k["seq"], pid, k["abstract"], k["cites"], k["pdf"], k["pmc"], k["full"], k["text"]) for pid, k in store.items())


def test_catalog_equals_arrival_order(spark):
    rng = random.Random(3)
    for _ in range(4):
        rows = random_papers(rng, 60)
        df = spark.createDataFrame(rows, PAPER)
        got = sorted(tuple(r) for r in C.resolve_catalog(df).select(
            "seq", "paper_id", "abstract", "citation_count", "open_access_pdf_url", "pmcid", "full_text_available",
            "full_text_content").collect())
        assert got == sequential_catalog(rows)


def test_running_totals_and_numbers_cross_buckets(spark):
    rng = random.Random(1)
    rows = [(i % 2 if i % 5 else 0, i, rng.randint(0, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "k bigint, o bigint, v bigint")
    got = {(r.k, r.o): (r.total, r.n) for r in number_rows(
        running_totals(df, ["k"], "o", {"total": F.col("v")}, bucket_rows=7), ["k"], "o", "n", bucket_rows=7).collect()}
    total, n = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        total[k], n[k] = total.get(k, 0) + v, n.get(k, 0) + 1
        assert got[(k, o)] == (total[k], n[k])


def test_trailing_rows_cross_buckets(spark):
    rows = [(1, i * 3, str(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "k bigint, o bigint, v string")
    got = {r.o: list(r.prev) for r in trailing_rows(df, ["k"], "o", 4, F.col("v"), "prev", bucket_rows=6).collect()}
    for i, (_, o, _) in enumerate(rows):
        assert got[o] == [r[2] for r in rows[max(0, i - 4):i]]


def test_packing_equals_greedy(spark):
    rng = random.Random(7)
    rows = [(rng.choice([1, 1, 1, 2]), i, rng.choice([1, 5, 40, 99, 130, 250])) for i in range(400)]
    df = spark.createDataFrame(rows, "k bigint, o bigint, n bigint")
    for bucket in (5, 64, 1000):
        got = {(r.k, r.o): r.batch for r in pack_batches(df, "k", "o", "n", 200, bucket_rows=bucket).collect()}
        used, batch = {}, {}
        for k, o, n in rows:
            if k not in used or used[k] + n > 200:
                used[k], batch[k] = 0, batch.get(k, -1) + 1
            used[k] += n
            assert got[(k, o)] == batch[k]


def test_first_wins_linkage(spark):
    rng = random.Random(5)
    rows = [(r[0] % 3, r[0] * 10, *r) for r in random_papers(rng, 80)]
    df = spark.createDataFrame(rows, "query_id bigint, ord bigint, " + PAPER)
    got = {(r.query_id, r.link_key): (r.ord, r.open_access_pdf_url, r.abstract) for r in C.link_search_hits(df).collect()}
    want = {}
    for q, o, *r in rows:
        key = (q, ("doi:" + r[5].strip().lower()) if r[5] else None or "title:" + r[1])
        if key not in want:
            want[key] = [o, r[8], r[4]]
        elif r[5]:
            want[key][1] = want[key][1] or r[8] or want[key][1]
            want[key][2] = want[key][2] or r[4] or want[key][2]
    assert sorted(map(repr, got.values())) == sorted(repr(tuple(v)) for v in want.values())


def chase(seeds, edges, papers, max_depth, per_study, budget):
    """The chase paper by paper: a paper reads no more entries than tries are left."""
    seen, left, want = set(seeds), budget, {}
    # A seed without text has no references to follow.
    frontier = [p for p in seeds if papers[p][2]]
    for depth in range(1, max_depth + 1):
        tried = []
        for paper in frontier:
            remaining = left - len(tried)
            if remaining <= 0:
                break
            for _, _, cited in [x for x in edges if x[0] == paper][:min(per_study, remaining)]:
                if cited not in seen:
                    seen.add(cited)
                    tried.append(cited)
        left -= len(tried)
        for cited in tried:
            want[cited] = (depth, papers[cited][2] and papers[cited][1] >= 1)
        frontier = [c for c in tried if want[c][1]]
    return want


def test_snowball_budget_counts_tries(spark):
    edges = [(p, e, (p * 5 + e * 3) % 40) for p in range(40) for e in (1, 2, 3)]
    papers = [(p, p % 3, p % 4 != 0) for p in range(40)]
    e = spark.createDataFrame(edges, "paper bigint, entry_no bigint, cited bigint")
    p = spark.createDataFrame(papers, "paper bigint, n_verified bigint, has_text boolean")
    seeds = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "paper bigint, ord bigint")
    got = X.citation_snowball(seeds, e, p, max_depth=4, per_study=2, budget=9).collect()
    assert len(got) == 9
    assert {r.paper: (r.depth, r.kept) for r in got} == chase([0, 1, 2], edges, papers, 4, 2, 9)


def test_snowball_share_narrows_at_the_end_of_the_budget(spark):
    # Many seeds cite the same few works first, so late papers spend their narrowed share on works already tried.
    rng = random.Random(3)
    edges = [(p, e, rng.randrange(12) if e < 4 else rng.randrange(60)) for p in range(60) for e in range(1, 8)]
    papers = [(p, p % 3, p % 4 != 0) for p in range(60)]
    e = spark.createDataFrame(edges, "paper bigint, entry_no bigint, cited bigint")
    p = spark.createDataFrame(papers, "paper bigint, n_verified bigint, has_text boolean")
    first = [50, 51, 53, 54, 55, 57, 58, 59]
    seeds = spark.createDataFrame(list(zip(first, range(8), strict=True)), "paper bigint, ord bigint")
    for budget in (1, 5, 14, 23, 1000):
        got = X.citation_snowball(seeds, e, p, max_depth=3, per_study=5, budget=budget).collect()
        assert len(got) <= budget
        assert {r.paper: (r.depth, r.kept) for r in got} == chase(first, edges, papers, 3, 5, budget)


def test_first_rows(spark):
    rows = [(i * 37 % 101, i % 2) for i in range(101)]
    df = spark.createDataFrame(rows, "o bigint, v bigint").repartition(7)
    for n in (0, 1, 50, 101, 500):
        assert sorted(r.o for r in first_rows(df, n, "o").collect()) == list(range(min(n, 101)))
