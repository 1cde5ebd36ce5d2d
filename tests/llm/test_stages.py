import random

from wardgate.llm import stages

SF = "/root/testdata/sf0.001"


def test_letters_of_no_language_go(spark):
    rng = random.Random(2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    letters = lambda signs, n: " ".join("".join(rng.choice(signs) for _ in range(rng.randint(3, 9))) for _ in range(n))
    junk = [letters(s, n) for s in ("abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz", "абвгдежзиклмно") for n in (10, 200)]
    rows = [(9000 + i, t, "en", "s", len(t)) for i, t in enumerate(junk)] + [(9900, "x" * 3000, None, "s", 3000)]
    mixed = docs.union(spark.createDataFrame(rows, docs.schema))
    kept = {r.doc_id for r in stages.language(spark, mixed, SF).collect()}
    assert kept == {r.doc_id for r in docs.collect()}


def test_shared_passages_of_51_words_go(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    own = lambda: " ".join(word(6) for _ in range(60))
    passage, short = (" ".join(word(5) for _ in range(n)) for n in (51, 45))
    accented = " ".join("é" + word(3) for _ in range(51))
    few_words = " ".join(word(60) for _ in range(8))  # over 400 bytes
    assert 200 < len(short) < len(passage) < 400 and len(accented.encode()) < 400 < len(few_words)
    texts, want = {}, {}
    for i, (p, goes) in enumerate([(passage, True), (short, False), (accented, True), (few_words, True)]):
        for k in (0, 1):
            a, b = own() + "xy"[k], "xy"[k] + own()
            texts[2 * i + k] = f"{a}. {p}, {b}"
            want[2 * i + k] = f"{a}{b}".replace(" ", "") if goes else texts[2 * i + k].replace(" ", "")
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in stages.repeated_substrings(spark, docs, "").collect()}
    bare = {i: t.replace(" ", "").replace(".", "").replace(",", "") for i, t in got.items()}
    assert bare == {i: t.replace(".", "").replace(",", "") for i, t in want.items()}


def test_words_cut_by_an_end_do_not_count():
    data = "één twee drie vier".encode()
    assert stages.whole_words(data, 0, len(data)) == 4
    assert stages.whole_words(data, 0, len(data) - 2) == 3
    assert stages.whole_words(data, data.index(b"wee"), data.index(b" vier")) == 1
