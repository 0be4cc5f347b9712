"""Each method against brute force, simulated data or held-out rows."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from helioflux.llm import decontaminate, near_dedup, outliers, quality, secrets, sharding, store, tokens, toxicity, urlrules

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_contamination_in_groups_and_digests(spark, docs):
    """Items searched in several groups give what one group gives; the digest is that of the items by brute force."""
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    one = decontaminate.contamination(docs, bench).orderBy("doc_id").collect()
    assert one == decontaminate.contamination(docs, bench, group_mb=0.003).orderBy("doc_id").collect()
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    items = {str(r.item_id): words(r.text) for r in bench.collect()}
    text = {r.doc_id: words(r.text) for r in docs.collect()}
    for r in one:
        held = {" ".join(text[r.doc_id][i : i + 13]) for i in range(len(text[r.doc_id]) - 12)}
        found = sorted(k for k, w in items.items() if any(" ".join(w[i : i + 13]) in held for i in range(len(w) - 12)))
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest() and r.n_items == len(found)


def test_contaminated_rows_go_whatever_their_id(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = spark.createDataFrame([(None, item, "a"), (None, "clean text", "b"), (1, item, "c"), (1, "other", "d"), (2, None, "e")], "doc_id long, text string, matches string")
    out = decontaminate.removed(rows, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert out.columns == rows.columns and sorted(r.matches for r in out.collect()) == ["b", "d", "e"]


def test_part_of_a_key_scores_below_the_key():
    rng = np.random.default_rng(4)
    keys = ["".join(rng.choice(list("0123456789abcdef"), 20)) for _ in range(400)]
    formats = secrets.fit({"hex": keys}, [f"word{i}" for i in range(300)])
    assert formats.best(keys[0])[1] > formats.best(keys[0][:17])[1] + 0.3
    assert formats.automata["hex"].left[0] == {20: 400}


def test_all_spans_are_scored(spark):
    rows = [(i, f"token={'%040x' % (i * 7919**9)}"[:46]) for i in range(60)] + [(99, None), (98, "")]
    out = secrets.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(len(r.scores) == len([s for s in r.spans.split(",") if s]) for r in out)
    assert all(np.isfinite(x) for r in out for x in r.scores) and {r.spans for r in out if r.doc_id > 90} == {""}


def test_label_model_discounts_copies_of_a_voter():
    """Nine voters, six of them copies of one: the tree counts the copies once, so its posteriors are right."""
    rng = np.random.default_rng(6)
    n = 20000
    y = rng.random(n) < 0.3
    vote = lambda: rng.random(n) < np.where(y, 0.7, 0.2)
    first = vote()
    columns = [first, *[first.copy() for _ in range(5)], vote(), vote(), vote()]
    masks = sum(c.astype(np.int64) << i for i, c in enumerate(columns))
    known = slice(0, 2000)
    fixed = toxicity.counted(masks[known], y[known].astype(float), np.ones(2000), 9)
    model = toxicity.tree_model(fixed)
    for _ in range(5):
        p = toxicity.sigmoid(model.log_odds(masks))
        model = toxicity.tree_model(fixed + toxicity.counted(masks, p, np.ones(n), 9))
    odds = np.log(0.3 / 0.7) + sum(np.where(c, np.log(0.7 / 0.2), np.log(0.3 / 0.8)) for c in (first, *columns[6:]))
    assert np.abs(toxicity.sigmoid(model.log_odds(masks)) - toxicity.sigmoid(odds)).mean() < 0.05


def test_outlier_estimates_against_numpy(spark):
    """A clean group with a tenth of far rows: far ones are cut, and distances are those of the clean rows' own moments."""
    rng = np.random.default_rng(8)
    rows = [(i, "en", "a", int(n), int(n * c), int(s), int(d), 0) for i, (n, c, s, d) in enumerate(zip(rng.lognormal(6, 0.6, 900), rng.normal(5, 0.3, 900), rng.poisson(3, 900), rng.poisson(1, 900), strict=True))]
    rows += [(1000 + i, "en", "a", 400, 2000, 300, 0, 0) for i in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long").repartition(4)
    d2 = {r.doc_id: r.d2 for r in outliers.distances(table).collect()}
    assert min(d2[1000 + i] for i in range(100)) > outliers.CUTOFF > np.quantile([d2[i] for i in range(900)], 0.99)
    x = np.array([[np.log1p(n), np.log(c / n), np.log1p(100 * s / n), np.log1p(100 * d / n), 0.0] for _, _, _, n, c, s, d, _ in rows[:900]])
    inverse = np.linalg.inv(np.cov(x.T, bias=True) + np.diag(np.square(outliers.FLOORS)))
    off = x - x.mean(axis=0)
    want = np.einsum("ij,jk,ik->i", off, inverse, off)
    assert np.corrcoef(want, [d2[i] for i in range(900)])[0, 1] > 0.97


def test_chi_square():
    assert outliers.quantile(0.999) == pytest.approx(20.515, abs=1e-3) and outliers.quantile(0.5) == pytest.approx(4.3515, abs=1e-3)


def test_mined_rules_by_brute_force(spark):
    """All token sets counted directly; tokens that always go together count as one."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):
        items = {t for t in "abcde" if rng.random() < 0.5}
        rows.append((i, sorted(items), bool({"a", "b"} <= items and rng.random() < 0.95 or "e" in items and rng.random() < 0.7)))
    got = {tuple(r.antecedent): (r.support, r.confidence) for r in urlrules.mined(spark.createDataFrame(rows, "row long, items array<string>, bad boolean"), 0.05, 0.6, 20)[0].collect()}
    rules = {}
    for k in range(1, 6):
        for some in itertools.combinations("abcde", k):
            has = [bad for _, items, bad in rows if set(some) <= set(items)]
            if sum(has) >= 20 and sum(has) / len(has) >= 0.6:
                rules[some] = (sum(has) / 400, sum(has) / len(has))
    want = {s: v for s, v in rules.items() if not any(set(o) < set(s) and rules[o][1] >= v[1] for o in rules)}
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_each_token_of_a_class_fires(spark):
    """Bad URLs all hold one host label and one path, so the labels don't tell which is bad: either is, alone too."""
    urls = [f"http://evil.x{i}.info/zz" for i in range(50)] + [f"http://good.y{i}.info/aa" for i in range(50)]
    new = ["http://evil.other.info/", "http://fine.other.info/zz", "http://fine.other.info/aa", "http://fine.other.info/", "http://good.other.info/zz"]
    pages = spark.createDataFrame(list(enumerate(urls + new)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 50), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in urlrules.judged(pages, labels).where("page_id >= 100").collect()}
    assert got == {100: "block", 101: "block", 102: "allow", 103: "allow", 104: "block"}


def test_verdicts_by_brute_force(spark):
    """All rules of all token sets over a small table, each token of its own, against mined and matched classes."""
    rng = np.random.default_rng(13)
    hosts, paths = ["a", "b", "c"], ["p", "q", "r", "s"]
    urls, bad = [], []
    for _ in range(300):
        h, p = rng.choice(hosts), rng.choice(paths)
        url = f"http://{h}.site/{p}" + ("/extra" if p == "p" else "") + ("?k=1" if h == "c" else "")
        urls.append(url)
        bad.append(bool((h == "a" and p == "p") or (h == "c" and rng.random() < 0.9) or rng.random() < 0.05))
    new = [f"http://{h}.site/{p}{t}" for h in hosts for p in paths for t in ("", "/extra", "?k=1")]
    pages = spark.createDataFrame(list(enumerate(urls + new)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not b), 0) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    kinds = urlrules.parsed(pages).select("page_id", urlrules.tokens().alias("t")).collect()
    items = {r.page_id: set(r.t) for r in kinds}
    known = [(items[i], bad[i]) for i in range(300)]
    rules = []
    every = sorted(set().union(*items.values()))
    for k in range(1, 4):
        for some in itertools.combinations(every, k):
            has = [b for t, b in known if set(some) <= t]
            if sum(has) >= 20 and sum(has) / len(has) >= 0.6:
                rules.append(set(some))
    got = {r.page_id: r.verdict for r in urlrules.judged(pages, labels, rules=()).collect()}
    assert got == {i: "block" if any(s <= t for s in rules) else "allow" for i, t in items.items()}
    assert set(got.values()) == {"block", "allow"}


def test_url_edges(spark):
    rows = [(1, "http://h.info/a.exe#x", "r"), (1, "http://h.info/a.exe#x", "r"), (None, "http://h.info/b", "r"), (2, None, "r")]
    labels = spark.createDataFrame([(1, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    out = urlrules.judged(spark.createDataFrame(rows, "page_id long, url string, rule string"), labels)
    assert out.count() == 4 and {r.verdict for r in out.collect()} == {"allow"}
    kinds = urlrules.parsed(spark.createDataFrame(rows[:1], "page_id long, url string, rule string")).select(urlrules.tokens().alias("t")).first().t
    assert sorted(kinds) == ["ending:exe", "fragment:x", "host:h", "host:info", "pair:h.info", "path:a.exe"]


def test_placed_keeps_user_columns(spark):
    rows = spark.createDataFrame([(i, f"t{i}", "l", "k", -1) for i in range(40)], "doc_id long, text string, law string, _key string, slot int")
    out = sharding.placed(rows)
    assert out.columns == ["doc_id", "text", "law", "_key", "shard", "slot"] and {(r.law, r._key) for r in out.collect()} == {("l", "k")}


def test_equal_rows_get_gapless_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUP_ROWS", 50)
    out = sharding.sharded(spark.createDataFrame([(7, "same")] * 500, "doc_id long, text string").repartition(4)).collect()
    assert sorted(r.slot for r in out) == list(range(500)) and len({r.shard for r in out}) == 1


def test_texts_under_one_id_all_link(spark):
    words = lambda a: " ".join(f"{a}{i}" for i in range(40))
    rows = [(5, words("x")), (5, words("y")), (9, words("x")), (3, words("y") + " z"), (8, words("q")), (None, words("q"))]
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 3), (9, 3), (3, 3), (8, 8), (None, None)}


def test_section_tokens_sum_to_the_whole_encoding(spark, docs):
    import tiktoken

    held = tokens._encoder(tokens.vocabulary_of(None), tokens.default_pattern())[0]
    assert isinstance(held, tiktoken.Encoding)
    text = {r.doc_id: r.text for r in docs.limit(40).collect()}
    for rule in tokens.RULES:
        got = tokens.section_tokens(docs.where(F.col("doc_id").isin(list(text))), rule).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("end_char").alias("end"))
        assert {r.doc_id: (round(r.n, 6), r.end) for r in got.collect()} == {d: (len(held.encode_ordinary(t)), len(t)) for d, t in text.items()}


def test_quality_on_rows_it_never_saw(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classified(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    kept = {r.quality: r.p for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("p")).collect()}
    assert kept[1] > 0.97 and kept[0] < 0.3, kept


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        store.shared_dir(Session())
