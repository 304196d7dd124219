"""The posting index and stems against published words and brute force."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from lakefolio.functions import stems
from lakefolio.functions import text as T
from lakefolio.operators import postings
from lakefolio.plans.finding import fields
from lakefolio.sources.tables import scan

DATA = "/root/testdata/sf0.001"
KEY = b"k"
ENGLISH = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol
consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort
conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knave knave knavish knavish
kneaded knead kneading knead knee knee kneeled kneel kneels kneel knees knee knightly knight knitted knit knitting knit knives knive knocker knocker knocking knock
generously generous skies sky dying die hopping hop hoping hope relational relat early earli news news proceed proceed"""
GERMAN = """aufeinander aufeinand aufeinanderbiss aufeinanderbiss aufeinanderfolge aufeinanderfolg aufeinanderfolgen aufeinanderfolg aufeinanderfolgend aufeinanderfolg
aufeinanderfolgenden aufeinanderfolg aufeinanderfolgender aufeinanderfolg aufeinanderfolgt aufeinanderfolgt aufeinanderschlügen aufeinanderschlug aufenthalt aufenthalt
aufenthalten aufenthalt aufenthaltes aufenthalt auferlegen auferleg auferlegten auferlegt auferstanden auferstand auferstehung aufersteh auferstünde auferstund
kategorie kategori kategorien kategori kategorisch kategor kategorische kategor katze katz katzen katz käufer kauf kaufmann kaufmann käuflich kauflich"""


def test_published_stems():
    for stem, table in ((stems.english, ENGLISH), (stems.german, GERMAN)):
        said = table.split()
        assert [stem(w) for w in said[::2]] == said[1::2]
    assert stems.stems("versicherungen") == ["versicher", "versicherungen"] and stems.stems("a") == []


def plain_terms(word):
    folded = word.translate(str.maketrans(T.FOLDS))
    out = {("W", folded)} | {("S", s) for s in stems.stems(word)}
    if word in T.COMMON_WORDS or folded in T.COMMON_WORDS or folded.isdigit():
        return out
    out |= {("P", folded[:n]) for n in range(3, min(15, len(folded) - 1) + 1)}
    return out | ({("X", folded[n:]) for n in range(3, len(folded) - 3)} if len(folded) >= 8 else set())


def plain_search(docs, query):
    """BM25 over dictionaries."""
    tf, length = collections.Counter(), {}
    for r in docs:
        words = {f: [w for w in re.findall(r"[^\W_]+", (r[f] or "").lower()) if 2 <= len(w) <= 40] for f in postings.FIELDS}
        length[r.doc_id] = max(1, len(words["title"]) + len(words["content"]))
        for f, some in words.items():
            for w, n in collections.Counter(some).items():
                for t in plain_terms(w):
                    tf[t, f, r.doc_id] += n
    mean, by = sum(length.values()) / len(length), collections.defaultdict(list)
    for (t, f, d), n in tf.items():
        by[t].append((f, d, n))
    said, best = postings.query_words(query), collections.defaultdict(dict)
    for i, word in enumerate(said):
        for t, w in postings.query_terms(word).items():
            for f, d, n in by[t]:
                s = w * postings.FIELDS[f] * n * 2.2 / (n + 1.2 * (0.4 + 0.6 * length[d] / mean))
                best[i][d] = max(best[i].get(d, 0), s)
    n = len(length)
    idf = {i: math.log(1 + (n - len(b) + 0.5) / (len(b) + 0.5)) for i, b in best.items()}
    every = set.intersection(*(set(best[i]) for i in range(len(said))))
    return {d: round(sum(best[i][d] * idf[i] for i in range(len(said))), 6) for d in every}


@pytest.fixture(scope="module")
def docs(spark):
    return fields(scan(spark, DATA, "documents")).cache()


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    postings.write(docs, folder, KEY)
    return folder


def found(spark, folder, query):
    return {r.doc_id: r.score for r in postings.search(spark, folder, query, KEY, limit=10_000).collect()}


@pytest.mark.parametrize("query", ["licenses versions", "the tion", "Öffnungen", "lich apache"])
def test_search_with_stems_is_the_definition(spark, docs, index, query):
    got, want = found(spark, index, query), plain_search(docs.collect(), query)
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 2e-6 for d in got)


def test_a_query_reads_its_buckets(spark, index):
    terms = [postings.hash_of("W", "license", KEY), postings.hash_of("W", "apache", KEY)]
    plan = postings.postings(spark, index, terms)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan
    files = {r.f for r in postings.postings(spark, index, terms).select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(files) <= 2
    hashes = postings.dictionary(spark.createDataFrame([("fußweg",)], "word string"), KEY).select(F.explode("terms")).select("col.*").collect()
    assert {(r.kind, r.term) for r in hashes} == {(k, postings.hash_of(k, v, KEY)) for k, v in plain_terms("fußweg")}


def test_replaced_and_removed_documents(spark, docs, index, tmp_path):
    both, fresh, small = (str(tmp_path / n) for n in ("both", "fresh", "small"))
    new = docs.filter("doc_id < 40").withColumn("content", F.lit("Entirely new licenses of versions")).withColumn("title", F.lit(None).cast("string"))
    postings.write(docs, both, KEY)
    postings.write(docs, both, KEY, version=1)  # the same again
    assert found(spark, both, "licenses versions") == found(spark, index, "licenses versions")
    postings.write(new, both, KEY, version=2)
    postings.remove(docs.filter("doc_id >= 150"), both, version=3)
    postings.write(docs.filter("doc_id >= 40 AND doc_id < 150").unionByName(new), fresh, KEY)
    postings.compacted(spark, both, small)
    for query in ("licenses versions", "the"):
        want = found(spark, fresh, query)
        assert want and found(spark, both, query) == want == found(spark, small, query)
    assert spark.read.parquet(f"{small}/postings").count() == spark.read.parquet(f"{fresh}/postings").count()


def test_odd_documents_and_pages(spark, tmp_path):
    rows = [(1, None, None, None), (2, "", "", ""), (3, "a b", "x", "y"), (4, "same words", "same", None), (4, "same words", "same", None)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, content string, meta string")
    folder = str(tmp_path / "odd")
    postings.write(docs, folder, KEY)
    assert {r.doc_id: r.length for r in postings.statistics(spark, folder).collect()} == {1: 1, 2: 1, 3: 1, 4: 6}
    assert [(r.doc_id, r.total) for r in postings.search(spark, folder, "same", KEY).collect()] == [(4, 1)]
    assert postings.search(spark, folder, "same", KEY, offset=1).count() == 0 and postings.search(spark, folder, "  !", KEY).count() == 0
    assert postings.search(spark, folder, "same", KEY, candidates=docs.filter("doc_id = 3")).count() == 0


def test_signatures_are_the_most_frequent_stems(spark, docs):
    want = {}
    for r in docs.collect():
        counts = collections.Counter()
        for w in re.findall(r"[^\W_]+", (r.content or "").lower()):
            if 2 <= len(w) <= 40:
                counts.update(stems.stems(w))
        want |= {(r.doc_id, i + 1): (s, n) for i, (s, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:300])}
    assert {(r.doc_id, r.place): (r.stem, r.tf) for r in postings.signatures(docs).collect()} == want
