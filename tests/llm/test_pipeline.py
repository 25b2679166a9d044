"""Each stage of the corpus pipeline against a brute-force version on the smallest documents."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from roomflux.llm import pii, quality
from roomflux.plans.lineage import materialize

from .test_operators import BASE, brute_targets, check_pack, pii_base, words_of

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DIR), "test")
        out.append(docs)
    return out


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "pii", "source mixing", "best-fit packing"]
    assert all(s.columns == stages[0].columns for s in stages[:5])


def test_quality_keeps_what_the_classifier_predicts(spark, stages):
    scores = quality.quality_scores(stages[0], spark.read.parquet(f"{DIR}/labels.parquet")).where("predicted = 1").select("doc_id")
    assert rows(stages[1]) == rows(stages[0].join(scores, "doc_id", "left_semi").select(*stages[0].columns))


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def test_one_of_each_group(stages):
    """Groups are those of all pairs of Jaccard 0.8 or more: none of them is lost, and no pair below is joined."""
    docs = [tuple(r) for r in stages[1].collect()]
    sets = [shingles(r[1]) for r in docs]
    group = list(range(len(docs)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    linked = 0
    for a in range(len(docs)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                linked += 1
                group[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, r in enumerate(docs):
        least[root(k)] = min(least.get(root(k), r), r, key=lambda r: r[0])
    assert linked
    assert rows(stages[2]) == Counter(least.values())


def redacted(text):
    spans = sorted(pii_base(text), key=lambda s: (s[1], -s[2]))
    out, at = [], 0
    for kind, a, b in spans:
        if b > at:
            out += [text[at : max(a, at)], f"[{kind.upper()}]"]
            at = b
    return "".join(out) + text[at:]


def test_personal_data_is_gone(stages):
    found = pii.find(stages[2])
    assert found.where("size(spans) <> size(base)").count() == 0  # nothing but base spans in these documents
    want = Counter()
    for r in stages[2].collect():
        new = redacted(r["text"])
        want[r["doc_id"], new, r["lang"], r["source"], len(new) if new != r["text"] else r["n_chars"]] += 1
    assert rows(stages[3]) == want
    assert set(BASE) == set(pii.KINDS)


def test_mixture(stages):
    before = {r["doc_id"]: r for r in stages[3].collect()}
    sizes = Counter()
    for r in before.values():
        sizes[r["source"]] += words_of(r["text"])
    want = brute_targets(sizes)
    took, whole, parts = Counter(), Counter(), defaultdict(list)
    for r in stages[4].collect():
        own = before[r["doc_id"]]
        took[r["source"]] += words_of(r["text"])
        if r["text"] == own["text"]:
            whole[r["doc_id"]] += 1
        else:
            parts[r["source"]].append(r)
            assert own["text"].split()[: words_of(r["text"])] == r["text"].split()
    assert max(whole.values()) <= 3 and all(len(p) <= 1 for p in parts.values())
    assert all(abs(took[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)


def test_packed(stages):
    check_pack(stages[5].collect(), [(r["doc_id"], r["text"]) for r in stages[4].collect()])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, likely boolean, __doc string, __text string, __hash long, __id long, __u long"
CASES = [
    (None, None, None, None, None),
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n ", "en", "a", 3),
    (4, "one two", "en", "b", 7),
    (4, "one two", "en", "b", 7),
    (5, "x " * 60_000 + "mail a@b.cd", "en", None, 120_011),
    (None, "mail a@b.cd again", "en", "b", 17),
]


@pytest.mark.parametrize("filled", [True, False])
def test_stages_with_nulls_repeats_and_clashing_names(spark, filled):
    """Each stage on rows of nulls, empty and long texts and repeats, on an empty table, and with columns named like its own."""
    docs = spark.createDataFrame([(*r, True, "d", "t", 3, 4, 5) for r in CASES] if filled else [], SCHEMA)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, DIR), "odd")
        seen[name] = out.collect()
        if name != "best-fit packing":
            assert out.schema == docs.schema
            docs = out if name != "quality classifier" else docs
    if not filled:
        assert not any(seen.values())
        return
    kept = Counter(r["doc_id"] for r in seen["simhash near-dedup"])
    assert kept == Counter({None: 2, 1: 1, 4: 1, 5: 1})  # 1, 2 and 3 have no words and are one group
    assert not any("a@b.cd" in (r["text"] or "") for r in seen["pii"])
    assert all(r["__hash"] == 3 and r["__id"] == 4 and r["__u"] == 5 for r in seen["source mixing"])
    check_pack(seen["best-fit packing"], [(r["doc_id"], r["text"]) for r in seen["source mixing"]])
