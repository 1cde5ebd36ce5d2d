from collections import Counter, defaultdict

from pyspark.sql import functions as F

from test_packing import check_places
from test_simhash import plain_components, plain_fingerprint
import corpus_pipeline
from wardgate.llm import stages

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def shared_spans(texts, m):
    """Maximal (start, end) byte runs of each text that strings of m bytes seen twice cover."""
    datas = [t.encode() for t in texts]
    seen = Counter(d[i : i + m] for d in datas for i in range(len(d) - m + 1))
    out = []
    for d in datas:
        spans = []
        for i in range(len(d) - m + 1):
            if seen[d[i : i + m]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + m
                else:
                    spans.append([i, i + m])
        out.append((d, spans))
    return out


def test_stages_equal_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame(
        [(9001, "123 ...", "en", "s", 7), (9002, None, "en", "s", 0), (9003, "", "en", "s", 0)], docs.schema
    )
    docs = docs.unionByName(extra)
    spoken = stages.language(spark, docs, SF)
    assert spoken.columns == docs.columns
    assert set(texts(docs)) - set(texts(spoken)) == {9001, 9002, 9003}

    kind = stages.toxic(spark, spoken, SF)
    assert kind.columns == docs.columns
    assert set(texts(kind)) <= set(texts(spoken)) and len(texts(kind)) > 0.8 * len(texts(spoken))

    apart = stages.near_duplicates(spark, kind, SF)
    assert apart.columns == docs.columns
    groups = plain_components({i: plain_fingerprint(t) for i, t in texts(kind).items()})
    assert sorted(r.doc_id for r in apart.collect()) == sorted(set(groups.values()))

    short = stages.repeated_substrings(spark, apart, SF)
    assert short.columns == docs.columns
    before, after = texts(apart), texts(short)
    assert set(before) == set(after)
    for i, (data, spans) in zip(before, shared_spans(before.values(), stages.PASSAGE_BYTES), strict=True):
        left, at = b"", 0
        for x, y in spans:
            if y - x >= 400 or stages.whole_words(data, x, y) >= 51:
                left, at = left + data[at:x], y
        assert after[i] == (left + data[at:]).decode(errors="ignore")
    assert short.where(F.length("text") != F.col("n_chars")).count() == 0

    rows = stages.packed(spark, short, SF).collect()
    assert {r.doc_id for r in rows} == set(after)
    check_places(rows, 2048)


def test_stages_take_empty_tables_and_repeats(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []
    twice = docs.limit(20).union(docs.limit(20))
    once = stages.near_duplicates(spark, twice, SF).collect()
    assert len({r.doc_id for r in once}) == len(once)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
    assert rows and all(sorted(p.piece for p in v) == list(range(len(v))) for v in docs.values())
    check_places(rows, 2048)
    assert corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "simhash", "substrings", "packing"]
