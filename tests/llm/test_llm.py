"""The operators on documents, on small cases and against brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import variants
from oracle import rows_of
from tidemark.llm import languages, leaks, mixing, queries, tokens
from tidemark.llm.words import words

QUERIES = sorted(queries.QUERIES)


def distance(a, b):
    """Least edit distance of ``a`` to any stretch of ``b``, by the plain table."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_bit_vectors_equal_the_table():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randrange(1, 90))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(0, 60))]
        assert leaks.edit_distance_within(a, b) == distance(a, b)


def test_pieces_obey_the_pigeonhole():
    for n in range(1, 200):
        size, least = leaks.piece_length(n), -(-n // 2)
        for length in range(least, n + 1):
            assert (length - size + 1) // size >= length // 10 + 1 or size == 1, (n, length)


def test_words_ignore_form():
    plain = ["the", "sharp", "tender", "didnt", "move", "640685"]
    for text in ("The sharp tender didn't move 6406.85", "THE <b>sharp</b> ten­der [12] didn’t\n\n move, 6406.85!", "<p>The</p><p>sharp</p> ten-\nder didn't&nbsp;move¹ 6406.85"):
        assert words(text) == plain
    assert words(None) == words("") == words("... !?") == []


def test_leaks_with_replacements_and_without():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    item = [rng.choice(vocabulary) for _ in range(70)]
    noise = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    index = leaks.ItemIndex([(7, " ".join(item)), (8, ""), (9, "...")], 0.5, 10)

    def document(length, replaced, spread=True):
        passage = item[:length]
        for i in (range(0, length, length // replaced)[:replaced] if spread else range(replaced)) if replaced else ():
            passage[i] = "other"
        return " ".join(noise(50) + passage + noise(50))

    assert index.find(document(70, 0))[0] == (7, 70)
    assert index.find(document(35, 3))
    assert index.find(document(70, 7))
    assert not index.find(document(30, 0))
    assert not index.find(document(70, 24))
    assert index.find(None) == index.find("") == []
    # two words of the item became one, and hits lie on one side of it only
    other = [f"u{i}" for i in range(43)]
    shifted = [*other[:6], "x", *other[7:13], "y", *other[15:]]
    assert leaks.repeats(other, shifted, [(20, 19)])


def test_leaks_equal_brute_force_over_substitutions():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(12)]
    for _ in range(150):
        n = rng.randrange(4, 40)
        item = [rng.choice(vocabulary) for _ in range(n)]
        length = rng.randrange(max(n // 3, 1), n + 1)
        start = rng.randrange(n - length + 1)
        passage = [w if rng.random() > 0.12 else "x" for w in item[start : start + length]]
        document = [f"d{i}" for i in range(5)] + passage + [f"e{i}" for i in range(5)]
        least = -(-n // 2)
        want = any(distance(item[i : i + k], document) <= k // 10 for k in range(least, n + 1) for i in range(n - k + 1))
        assert bool(leaks.ItemIndex([(1, " ".join(item))], 0.5, 10).find(" ".join(document))) == want


def test_long_and_repeating_texts_take_time_in_proportion():
    item = [f"w{i}" for i in range(70)]
    index = leaks.ItemIndex([(1, " ".join(item))], 0.5, 10)
    began = time.time()
    assert not index.find(" ".join(item[:14] * 5_000))
    assert index.find(" ".join(item[:14] * 5_000 + item))
    assert words("<!-- " * 50_000 + "a") and words("<!-- x --> a <!-- y -->b") == ["a", "b"]
    assert len(languages.units("x" * 300_000, 90)) > 2_000
    assert time.time() - began < 60


def test_leaks_in_blocks_equal_one_block(spark, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/eval_items.parquet")
    one = {tuple(r) for r in leaks.leaked_items(docs, items).collect()}
    assert one and one == {tuple(r) for r in leaks.leaked_items(docs, items, block_items=50).collect()}


def test_token_counts_of_long_and_odd_texts():
    encode = tokens.encoding(tokens.DEFAULT_VOCABULARY).encode_ordinary
    text = "Hello <|endoftext|> wörld, it's 12.5\nabc def\n\n x\nfoo 中文 " * 12_000
    assert tokens.count(text) == len(encode(text))
    assert tokens.count(None) == tokens.count("") == 0
    assert tokens.count("a" * 300_000) == len(encode("a" * 300_000))


def test_positions_invert_the_integral(spark):
    for schedule in (((0, 1), (1, 1)), ((0, 2), (1, 0)), ((0, 0), (0.5, 1), (1, 0.25)), ((0, 1), (0.3, 0), (0.6, 0), (1, 2))):
        rows = spark.range(101).select((F.col("id") / 100).alias("due")).withColumn("t", mixing.position(F.col("due"), schedule)).collect()

        def area(t):
            total = 0.0
            for (a, u), (b, v) in zip(schedule, schedule[1:]):
                x = min(max(t - a, 0), b - a)
                total += u * x + (v - u) / (b - a) * x * x / 2
            return total

        for r in rows:
            assert area(r["t"]) / area(1.0) == pytest.approx(r["due"], abs=1e-9)


def test_plan_is_the_largest_that_caps_allow():
    shares = {s.source: s for s in mixing.plan({"a": (0.5, 1), "b": (0.25, 4), "none": (0.25, 2), "off": (0.0, 3)}, {"a": (10, 1000), "b": (2, 100), "off": (1, 5)})}
    assert shares["a"].demand == pytest.approx(800) and shares["b"].demand == pytest.approx(400)
    assert shares["none"].demand == shares["off"].demand == 0
    assert mixing.plan({}, {}) == []


@pytest.mark.parametrize("per_task", [3, 50_000])
def test_mix_keeps_shares_caps_and_order(spark, per_task):
    rng = random.Random(2)
    rows = [(i, "big" if i % 3 else "small", rng.randrange(0, 60)) for i in range(400)] + [(1, "big", 5), (1, "big", 5)] + [(2, "big", 7)] * 11
    sizes = spark.createDataFrame(rows, "doc_id long, _source string, _tokens long")
    available = mixing.available_of(sizes)
    shares = mixing.plan({"big": (0.3, 1), "small": (0.7, 3)}, available)
    offsets = mixing.offsets(sizes, "doc_id", shares, per_task).collect()
    for s in shares:
        own = sorted((r["_before"], r["_tokens"]) for r in offsets if r["_source"] == s.source)
        at = 0
        for before, n in own:
            assert before == at
            at += n
        assert at == s.tokens
    used = mixing.mixed(sizes, "doc_id", shares).collect()
    total = sum(r["tokens"] for r in used)
    for s in shares:
        own = [r for r in used if r["source"] == s.source]
        assert abs(sum(r["tokens"] for r in own) - s.demand) <= 60
        assert max(r["repeat"] for r in own) <= s.cap
        assert sum(r["tokens"] for r in own) / total == pytest.approx(s.target, abs=0.02)
    assert all(0 <= r["position"] <= 1 for r in used)


def test_shares_are_reported(spark, small):
    for r in queries.p7_shares(spark, small).collect():
        assert r["most_uses"] <= 4 and (r["tokens"] == 0 or abs(r["actual_share"] - r["target_weight"]) < 0.05)
    for r in queries.p7_shares(spark, "/root/testdata/sf0.1").collect():
        assert abs(r["actual_share"] - r["target_weight"]) < 0.001
    positions = [r["position"] for r in queries.p7_mix(spark, small).collect()]
    assert positions == sorted(positions)


def test_labels(spark):
    cases = {"en": "en", "EN_gb": "en", " deu ": "de", "French": "fr", "zh-CN": "zh", "": None, None: None, "und": None, "n/a": None, "xx": None, "english text": None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "label string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", languages.label_language(df["label"]).alias("got")).collect())


@pytest.fixture(scope="module")
def model(spark):
    return languages.fit_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_documents_get_their_language(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 20 = 7").withColumn("known", languages.label_language(F.col("lang"))).where("known IS NOT NULL")
    rows = languages.document_passages(docs, model, keep=("known",)).collect()
    # some labels are wrong
    assert sum(r["known"] in r["languages"] for r in rows) / len(rows) > 0.92


def test_passages_of_a_mixed_text(model):
    text = "The company filed an amended report that corrects the number of shares outstanding this year.\n\nDie Nettoverschuldung sank auf 62 Millionen Dollar, und die Kreditlinie ist noch nicht gezogen. Der Vorstand rechnet nun mit einem besseren Ergebnis (cash flow).\n公司位于的工厂将于四月投产，并新增岗位。管理层目前预计全年营业利润上升。"
    found, nothing, blank = languages.labelled_passages([text, None, " 12 .. "], model)
    assert [p[2] for p in found] == ["en", "de", "zh"] and nothing == blank == []
    assert text[found[1][0] : found[1][1]].startswith("Die Netto") and all(0 < p[3] <= 1 for p in found)
    assert list(languages.counted_languages(found, model.settings)) == ["de", "en", "zh"]
    assert list(languages.counted_languages([(0, 9, "en", 1.0, 9), (9, 20, "fr", 1.0, 11)], model.settings)) == ["fr"]


def test_sparse_scores_equal_the_whole_product(model):
    texts = ["The board met. 12", "", "Der Vorstand tagt", "公司位于", " .. ", "ACME", "x" * 700] * 40
    spectrum = languages.Spectrum(model.settings)
    got = model.scores(texts, spectrum, block=64)
    assert got.shape == (len(texts), len(model.languages)) and abs(got - spectrum.vectors(texts) @ model.weights).max() < 1e-4


def test_other_scripts_get_no_language(model):
    text = "Компания сегодня объявила о результатах за третий квартал.\nThe company reported better results for the quarter than the market expected."
    found, alone = languages.labelled_passages([text, "회사는 오늘 3분기 실적을 발표했다."], model)
    assert [p[2] for p in found] == ["en"] and alone == []


def test_units_end_at_stops_and_lines():
    cut = lambda t: [t[s:e] for s, e, _ in languages.units(t, 90)]
    assert cut("One. Two!\nthree; 四。五") == ["One.", "Two!", "three;", "四。", "五"]
    assert cut("\n\n !! a. b") == ["!!", "a.", "b"] and cut("") == cut(" \n ") == []


def test_long_items_take_time_in_proportion():
    rng = random.Random(9)
    item = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    began = time.time()
    index = leaks.ItemIndex([(1, " ".join(item))], 0.5, 10)
    assert index.find(" ".join(item[:2500])) == [] and [n for _, n in index.find(" ".join(item[:3200]))][0] >= 3200
    assert time.time() - began < 60


def test_long_text_without_spaces_is_cut():
    spans = languages.units("x" * 1000 + "中" * 300, 90)
    assert spans[0][0] == 0 and spans[-1][1] == 1300 and max(e - s for s, e, _ in spans) <= 180


def test_nothing_to_learn_from_gives_no_language():
    model = languages.fit([], languages.Settings())
    assert list(languages.labelled_passages(["some text"], model)) == [[]]


def result(spark, name, at):
    df = queries.QUERIES[name](spark, at)
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    root = tmp_path_factory.mktemp("variants")
    return {f.__name__: variants.write(root / f.__name__, f) for f in (variants.empty, variants.with_nulls, variants.twice, variants.clashing)}


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, copies, name):
    assert result(spark, name, copies["empty"])[1].total() == 0


@pytest.mark.parametrize("name", QUERIES)
@pytest.mark.parametrize("variant", ["with_nulls", "clashing"])
def test_dirt_changes_nothing(spark, small, copies, name, variant):
    assert result(spark, name, copies[variant]) == result(spark, name, small)


@pytest.mark.parametrize("name", ["p6_found", "p8_found"])
def test_repeated_rows_change_nothing(spark, small, copies, name):
    assert result(spark, name, copies["twice"]) == result(spark, name, small)


def test_entry_has_the_queries():
    assert set(QUERIES) <= set(entry.queries())
