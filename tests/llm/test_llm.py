"""Brute force, exact round trips and hard cases for the training-text operators."""

import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taleweave.llm import boundaries, cooccur, languages, mixing, names, neardup, packing, pii, queries, sentences, sql, tokens, unify
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_query_equals_sql(spark, data, name):
    same(spark, data, queries.QUERIES[name], sql.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(sql.SQL)))
def test_query_runs(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


# ------------------------------------------------------------------ problem 1


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n，。é́", max_size=300), st.integers(1, 60), st.integers(0, 80))
def test_pieces_rebuild_the_text(text, limit, overlap):
    got = boundaries.pieces(text, limit, overlap)
    kept = max(0, min(overlap, limit - 1))
    assert all(0 < e - s <= limit for s, e, _ in got) or text == ""
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (_, e, _), (s, _, _) in zip(got, got[1:]):
        assert e - s == kept
    rebuilt = text[got[0][0] : got[0][1]] + "".join(text[s + kept : e] for s, e, _ in got[1:])
    assert rebuilt == text


def test_pieces_end_where_the_text_pauses():
    text = "One two three. " * 20
    assert all(k == "sentence" for _, _, k in boundaries.pieces(text, 100, 10)[:-1])
    assert boundaries.pieces("x" * 250, 100, 0) == [(0, 100, "hard"), (100, 200, "hard"), (200, 250, "end")]


def test_oversized_of_odd_rows(spark):
    configs = spark.createDataFrame([(1, 10, 2, True), (2, 20, 0, False)], "config_id int, max_chunk_size int, chunk_overlap int, is_default boolean")
    rows = [(1, "a b c d e f g h", None), (2, "a b c d e f g h", 2), (3, None, 1), (4, "", 1), (5, "x" * 11, 9), (5, "x" * 11, 9)]
    t = spark.createDataFrame(rows, "id long, text string, config_id int").withColumn("limit", F.lit(1)).withColumn("src", F.lit("clash"))
    got = boundaries.split_oversized(boundaries.with_limits(t, "t", "id", configs))
    assert Counter(r.row_id for r in got.filter("piece_no = 0").collect()) == {1: 1, 5: 2}
    assert boundaries.split_oversized(boundaries.with_limits(t.limit(0), "t", "id", configs)).count() == 0
    assert boundaries.split_oversized(boundaries.with_limits(t, "t", "id", configs.limit(0))).count() == 0


# ------------------------------------------------------------------ problem 2


def test_pairs_against_a_loop(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        m = [rng.choice(["Red_Fox", "red fox", " RED-FOX ", "bell", None, ""]) for _ in range(rng.randrange(3))]
        rows.append((str(rng.randrange(120)) if rng.random() > 0.02 else None, m if rng.random() > 0.1 else None, [rng.choice("abc")], [rng.choice(["X  y", "x y", "z"])]))
    df = spark.createDataFrame(rows, "story_id string, motifs array<string>, morals array<string>, characters array<string>").withColumn("item", F.lit(1))
    import re

    baskets: dict = {}
    for s, m, l, c in rows:
        if s is not None:
            b = baskets.setdefault(s, set())
            for kind, xs in (("motif:", m), ("moral:", l)):
                b.update(kind + re.sub(r"[\s_\-]+", "_", x.strip().lower()) for x in xs or [] if x and x.strip())
            b.update("character:" + re.sub(r"\s+", " ", x.strip()).lower() for x in c or [] if x and x.strip())
    n = Counter(x for b in baskets.values() for x in b)
    nab = Counter((x, y) for b in baskets.values() for x in b for y in b if x < y)
    want = {p: k for p, k in nab.items() if k >= 5 and k * 500 >= len(baskets)}
    got = {(r.item_a, r.item_b): r for r in cooccur.pairs(df).collect()}
    assert {p: r.n_ab for p, r in got.items()} == want
    assert all((r.n_a, r.n_b, r.n_baskets) == (n[a], n[b], len(baskets)) for (a, b), r in got.items())
    assert cooccur.pairs(df.limit(0)).count() == 0


def test_pairs_of_a_hot_basket(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("story_id"), F.array(F.concat(F.lit("m"), (F.col("id") % 7).cast("string"))).alias("motifs"), F.array(F.lit("l")).alias("morals"), F.lit(None).cast("array<string>").alias("characters"))
    got = {(r.item_a, r.item_b): r.n_ab for r in cooccur.pairs(df).collect()}
    assert len(got) == 7 and all(a == "moral:l" for a, _ in got)


def test_all_pairs_that_occur(spark):
    rows = [("s1", ["rare", "fox"], ["calm"], ["Lan"]), ("s2", ["fox"], None, ["Lan"])] + [(f"t{i}", ["fox"], ["calm"], None) for i in range(3000)]
    df = spark.createDataFrame(rows, "story_id string, motifs array<string>, morals array<string>, characters array<string>")
    got = {(r.item_a, r.item_b): r.n_ab for r in cooccur.pairs(df, min_support=1, min_share=0).collect()}
    assert got == {
        ("character:lan", "moral:calm"): 1, ("character:lan", "motif:fox"): 2, ("character:lan", "motif:rare"): 1,
        ("moral:calm", "motif:fox"): 3001, ("moral:calm", "motif:rare"): 1, ("motif:fox", "motif:rare"): 1,
    }


# ------------------------------------------------------------------ problem 3


@pytest.mark.parametrize(
    "dirty, clean",
    [("Thе fox", "The fox"), ("ｔｈｅ ｋｉｎｇ", "the king"), ("tấm lụa", "tấm lụa"), ("n​gười", "người"), ("a b", "a b"), ("Ðêm", "Đêm"), ("hilо", "hilo"), ("水镜⼦", "水镜子"), ("gеﬂickt", "geflickt"), ("чёрный", "чёрный")],
)
def test_look_alikes(dirty, clean):
    assert unify.mapped(dirty) == unicodedata.normalize("NFC", clean)


@pytest.mark.parametrize("text", ["The widow asked: \"Скоро рассвет\".", "他说：“走吧！”（好）", "古い　話", "क्‍ष लड़की", "น้ำ", "Cô bé – “đi…”", "a\r\n\r\nb  c", "И он у реки", "œuvre"])
def test_usual_characters_stay(text):
    assert unify.mapped(text) == text


RARE = [
    ("the kıng", "the king"), ("ɡold ɑnd ȷam", "gold and jam"), ("ɑ fox", "a fox"), ("น\u0e4d\u0e49\u0e32", "น\u0e49\u0e33"), ("ท\u0e4d\u0e32", "ท\u0e33"),
    ("fo\u206ax", "fox"), ("fo\u206fx", "fox"), ("fox\ufe00", "fox"), ("fo\u3164x", "fox"), ("fo\U000e0041x", "fox"), ("Go， fox！", "Go, fox!"), ("Đi（mau）", "Đi(mau)"),
    ("ल\u095cकी", "ल\u0921\u093cकी"), ("\u0928\u093c", "\u0929"),
]


def test_rare_look_alikes(spark):
    assert [unify.mapped(a) for a, _ in RARE] == [b for _, b in RARE]
    df = spark.createDataFrame([("s", i, "title", 1, a) for i, (a, _) in enumerate(RARE)], "src string, row_id long, field_name string, position int, value string")
    assert {r.row_id: r.canonical for r in unify.unified(df).collect()} == {i: b for i, (_, b) in enumerate(RARE)}
    assert unify.affected(df).count() == len(RARE)


@pytest.mark.parametrize("text", ["ışık yağmur", "she said /ɡɑt/ twice", "[ɡəʊld]", "他说ABC！", "走！\n（好）", "ल\u0921\u093cकी"])
def test_rare_characters_stay(text):
    assert unify.mapped(text) == text


def test_unified_values(spark):
    s = spark.createDataFrame([(1, "Thе fox", "x"), (2, "The fox", None), (3, None, ""), (1, "Thе fox", "x")], "story_row_id long, title string, text string").withColumn("value", F.lit(0))
    f = spark.createDataFrame([(9, ["ａb", None, "ab"]), (8, None)], "record_id long, characters array<string>")
    got = {(r.src, r.row_id, r.field_name, r.position): (r.canonical, r.changed) for r in unify.unified(unify.field_values(s, f)).collect()}
    assert got["stories", 1, "title", 1] == ("The fox", True) and got["stories", 2, "title", 1] == ("The fox", False)
    assert got["fairy_tales", 9, "characters", 1] == ("ab", True) and got["fairy_tales", 9, "characters", 3] == ("ab", False)
    assert {tuple(r) for r in unify.affected(unify.field_values(s, f)).collect()} == {("stories", 1, "title"), ("fairy_tales", 9, "characters")}
    assert unify.affected(unify.field_values(s.limit(0), f.limit(0))).count() == 0


def test_dirty_values_join_the_class_of_clean_ones(spark):
    rows = [(1, "Ca\u0301o", "x"), (2, "Cáo", "x"), (3, "C\u200báo", "fo\u0007x"), (4, "Cao", None), (5, "cáo", ""), (5, "cáo", "")]
    s = spark.createDataFrame(rows, "story_row_id long, title string, text string").withColumn("value", F.lit(1)).withColumn("form", F.lit(2))
    t = spark.createDataFrame([(7, ["Сáo", None]), (8, None)], "record_id long, characters array<string>")
    v = unify.field_values(s, t)
    by = unify.classes(unify.mapped_suspects(v), v).collect()
    assert sorted(r.canonical for r in by) == ["Cáo", "fox"]
    got = {(r.src, r.row_id, r.field_name): r.canonical for r in unify.unified(v).collect()}
    assert [got["stories", i, "title"] for i in (1, 2, 3, 4, 5)] == ["Cáo", "Cáo", "Cáo", "Cao", "cáo"] and got["fairy_tales", 7, "characters"] == "Cáo" and got["stories", 3, "text"] == "fox"
    assert unify.unified(v).count() == v.count()


# ------------------------------------------------------------------ problem 4


def test_labels():
    for label, code in [("VI", "vi"), ("vi-VN", "vi"), ("tiếng Việt", "vi"), ("en_US", "en"), ("русский", "ru"), ("und", None), ("", None), (None, None), ("unknown", None), ("zh-CN", "zh")]:
        assert languages.label_code(label) == code


def test_language_on_held_out_samples(spark, data):
    rows = spark.read.parquet(f"{data}/language_samples.parquet").collect()
    train = [(r.language, r.text) for r in rows if r.sample_id % 5]
    model = languages.Model(train, calibrate=True)
    held = [r for r in rows if r.sample_id % 5 == 0]
    right = sum(languages.posterior(model.text(r.text)[0])[0] == r.language for r in held)
    plain = [r for r in held if r.language == "vi"]
    assert right / len(held) > 0.98
    assert sum(languages.posterior(model.text(languages.fold(r.text))[0])[0] == "vi" for r in plain) / len(plain) > 0.95
    assert not any(model.rejected(r.language, r.text) for r in held)
    # calibration: the mean confidence of short snippets is their share of right ones, within 4 %
    got = []
    for r in held:
        words = r.text.split()
        for k in range(0, len(words) - 1, 2):
            language, p = languages.posterior(model.text(words[k])[0], model.temperature)
            got.append((p, language == r.language))
    for low, high in ((0.0, 0.9), (0.9, 0.99), (0.99, 1.01)):
        part = [x for x in got if low <= x[0] < high]
        assert len(part) > 30 and abs(sum(p for p, _ in part) / len(part) - sum(ok for _, ok in part) / len(part)) < (0.1 if high < 1 else 0.03)


def test_other_languages_are_rejected(spark, data):
    model = languages.Model([(r.language, r.text) for r in spark.read.parquet(f"{data}/language_samples.parquet").collect()], calibrate=True)
    for text in (
        "Era uma vez um rapaz que morava numa pequena casa junto ao rio com a sua avó e saía todos os dias para buscar lenha.",
        "Viveva in una piccola casa vicino al fiume con sua nonna e ogni giorno usciva per raccogliere la legna nel bosco.",
        "Жив собі колись хлопець, який мешкав з бабусею в маленькій хатині біля річки і щодня ходив до лісу по дрова.",
        "옛날 옛적에 강가의 작은 집에서 할머니와 함께 사는 소년이 있었습니다.",
    ):
        assert [(c, 0.5 < p <= 1) for _, _, c, p in languages.segments(model, text, None, {})] == [("und", True)]
    for text, code in (("He carried the wood home and ate his supper by the fire.", "en"), ("Она принесла домой дрова и села у огня.", "ru"), ("Ella llevó la leña a casa y cenó junto al fuego.", "es")):
        assert [c for _, _, c, _ in languages.segments(model, text, None, {})] == [code]


def test_own_label_is_left_out():
    above = [0.1] * 10
    assert languages.log_prior([1] + [0] * 9, above, "vi") == languages.log_prior([0] * 10, above, None)
    assert languages.log_prior(None, None, "vi") == {}


def test_language_segments(spark, data):
    samples = spark.read.parquet(f"{data}/language_samples.parquet")
    first = {r.language: r.text for r in samples.orderBy("sample_id").collect()}
    rows = [(1, first["en"], "en", None), (2, first["en"] + "\n\n" + first["th"], "en", {"source": "s"}), (3, first["fr"], None, {"filename": "a.md"}), (4, None, "vi", None), (5, "", "vi", None), (6, "12 34", "vi", None), (3, first["fr"], None, None)]
    t = spark.createDataFrame(rows, "record_id long, text string, language string, metadata map<string,string>").withColumn("source", F.lit(1))
    got = sorted((r.record_id, r.language_code) for r in languages.identify(t, samples, found_only=True).collect())
    assert got == [(2, "en"), (2, "th"), (3, "fr"), (3, "fr")]
    seg = languages.identify(t, samples).filter("record_id = 2").orderBy("segment_no").collect()
    assert [s.language_code for s in seg] == ["en", "th"] and seg[1].start_pos == len(first["en"]) + 3
    assert languages.identify(t.limit(0), samples).count() == 0


# ------------------------------------------------------------------ problem 5


def brute_pairs(rows):
    sets = {i: neardup.normal(t, x) for i, t, x in rows if x is not None}
    grams = {i: {s[k : k + 12] for k in range(max(1, len(s) - 11))} for i, s in sets.items()}
    ids = sorted(grams)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(grams[a] & grams[b]) >= 0.6 * len(grams[a] | grams[b])}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    rows, i = [], 0
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, 5)):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [rng.choice(words)], [w[k], rng.choice(words)]])
            rows.append((i, rng.choice([None, "T"]), " ".join(w).upper() if rng.random() < 0.2 else " ".join(w)))
            i += 1
    rows += [(i, None, None), (i + 1, None, ""), (i + 2, None, ""), (i + 3, "ab", "c"), (i + 4, "a", "b\r\nc")]
    df = spark.createDataFrame(rows, "record_id long, title string, text string").withColumn("id", F.lit(5)).withColumn("key", F.lit("k"))
    got = {(r.record_id_a, r.record_id_b) for r in neardup.all_pairs(df).collect()}
    assert got == brute_pairs(rows)
    g = {r.record_id: r.group_id for r in neardup.groups(df).collect()}
    assert all(g[a] == g[b] for a, b in got) and len(g) == len(rows) - 1
    links = {tuple(r) for r in neardup.near_duplicates(df)[0].select("rep_a", "rep_b").collect()}
    assert {tuple(r) for r in neardup.near_duplicates(df, exact=True)[0].select("rep_a", "rep_b").collect()} == links
    assert neardup.all_pairs(df.limit(0)).count() == 0


def test_the_bound_rejects_groups_and_groups_stay_small(spark):
    rng = random.Random(3)
    common = " ".join(str(rng.random()) for _ in range(3))
    texts = [common + "".join(rng.choice("abcdefghij") for _ in range(250)) for _ in range(300)]
    texts += [texts[0] + str(i) for i in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", F.lit(None).cast("string").alias("title"), "text")
    docs = df.mapInArrow(neardup._sketches(False), neardup._SKETCH.format("int")).drop("key")
    m = neardup.group_matrix(docs)
    sizes = [r[0] for r in m.select(F.size("ids")).collect()]
    assert sum(sizes) == 400 and max(sizes) <= 2 * neardup.GROUP and len(sizes) < 400
    assert neardup.qualifying(m).count() < neardup.qualifying(m, 1).count()
    got = {(r.a, r.b) for r in neardup.near_duplicates(df.withColumnRenamed("id", "record_id"))[0].select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).collect()}
    assert got == brute_pairs([(i, None, t) for i, t in enumerate(texts)])


def test_a_hot_group_of_copies(spark):
    text = " ".join(f"word{i}" for i in range(40))
    df = spark.range(90).select(F.col("id").alias("record_id"), F.lit("t").alias("title"), F.when(F.col("id") % 3 == 0, text).otherwise(F.concat(F.lit("x" * 30), F.col("id").cast("string"), F.sha2(F.col("id").cast("string"), 512))).alias("text"))
    assert neardup.all_pairs(df).count() == 30 * 29 // 2


# ------------------------------------------------------------------ problem 6


def split(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("parts_of", F.lit(1))
    out = [[] for _ in texts]
    for r in sentences.sentences(df, "id").orderBy("id", "sentence_no").collect():
        assert texts[r.id][r.start_pos - 1 : r.start_pos - 1 + r.n_chars] == r.sentence
        out[r.id].append(r.sentence)
    return out


def test_sentences(spark):
    got = split(
        spark,
        "Mr. J. R. Hollow paid 3.50 at St. Ives. Then he left! “Who goes there? Stop!” the boy cried. He said: “Go.” Next one",
        "Theo TS. Lê, tr. 5 có ghi. Bà nói: \"Đi… Ngay!\" Rồi thôi.\n\nPhần thứ 2\n\nHết",
        "他说：“走吧。”她喊着“不要！”就走了。「谁？」狐狸说。完",
        "वह गया। डॉ. मेघल ने कहा, \"आओ।\" फिर?",
        "ก่อนฟ้าสาง ยายเดิน 2.4 ลี้ ค่อย ๆ ไป",
        "—¡No! ¿Ya? —dijo ella. ¡Vamos! «Впусти! Кто?» — сказал он. Да",
        "Am 3. Mai ging er, z. B. nach Hause. „Halt! Wer da?“ rief sie. Ende",
        "cạn.Có phải ông không?Khương đi.",
        "", "  \n ", None,
    )
    assert got[0] == ["Mr. J. R. Hollow paid 3.50 at St. Ives.", "Then he left!", "“Who goes there? Stop!” the boy cried.", "He said: “Go.”", "Next one"]
    assert got[1] == ["Theo TS. Lê, tr. 5 có ghi.", 'Bà nói: "Đi… Ngay!"', "Rồi thôi.", "Phần thứ 2", "Hết"]
    assert got[2] == ["他说：“走吧。”", "她喊着“不要！”就走了。", "「谁？」狐狸说。", "完"]
    assert got[3] == ["वह गया।", 'डॉ. मेघल ने कहा, "आओ।"', "फिर?"]
    assert got[4] == ["ก่อนฟ้าสาง", "ยายเดิน 2.4 ลี้", "ค่อย ๆ ไป"]
    assert got[5] == ["—¡No! ¿Ya? —dijo ella.", "¡Vamos!", "«Впусти! Кто?» — сказал он.", "Да"]
    assert got[6] == ["Am 3. Mai ging er, z. B. nach Hause.", "„Halt! Wer da?“ rief sie.", "Ende"]
    assert got[7] == ["cạn.", "Có phải ông không?", "Khương đi."]
    assert got[8:] == [[], [], []]


def test_sentences_of_a_long_text(spark):
    text = "This is one. " * 3000
    assert len(split(spark, text)[0]) == 3000


# ------------------------------------------------------------------ problem 7


CAST = [(1, "Bành Quỳnh Đằng", "person", None), (2, "Tống Cát Thuyền", "person", ["Sún Ngõ Trầu"]), (3, "Matilda Larkspurrow", "person", None), (4, "Saltmarsh Reed Cutters Union", "organisation", None), (5, "The Lantern Toad", "creature", None), (6, "Cù Vân Đằng làng Hạ", "person", None), (7, "Bành Cát Nhài", "person", None)]


def catalogue(cast):
    return names.Vectors([v for m in cast for v in names.member_variants(*m)], {x for _, *m in cast for x in names.usual_parts(*m)})


@pytest.mark.parametrize(
    "form, who",
    [("BÀNH QUỲNH ĐẰNG", 1), ("Banh Quynh Dang", 1), ("Banhf Quynhf Ddawngf", 1), ("Bà Bành Quỳnh Đằng", 1), ("Đằng, Bành Quỳnh", 1), ("B. Q. Đằng", 1), ("Bành Đằng", 1), ("Bành-Quỳnh-Đằng", 1), ("Bnàh Quỳnh Đnằg", 1), ("Sún Ngõ Trầu", 2), ("sun ngo trau", 2), ("Thuyền (Sún Ngõ Trầu)", 2), ("Tilly Larkspurrow", 3), ("Larkspurrow, Matilda", 3), ("MatildaLarkspurrow", 3), ("SRCU", 4), ("Saltmarsh Reed Cutters Un.", 4), ("Lantern Toad", 5), ("Cù Vân Đằng (làng Hạ)", 6), ("Tống C. Thuyền", 2)],
)
def test_variants_link(form, who):
    assert catalogue(CAST).link(form) == {who}


@pytest.mark.parametrize("form", ["Bành Cát Đằng", "Tống Quỳnh Nhài", "the old toad", "a jar of thunder", "Bến Hạ", "", "  ", "bà mụ", "the latin road", "cái vân đằng làng hạ"])
def test_others_do_not_link(form):
    assert catalogue(CAST).link(form) == set()


def test_shared_variants_link_to_all():
    cast = [(1, "Saltmarsh Reed Cutters Union", "organisation", None), (2, "Silver River Carvers Union", "organisation", None), (3, "Stone Road Carters Union", "organisation", None), (4, "Lan", "person", ["Old Moth"]), (5, "Mai", "person", ["Old Moth"]), (6, "Sen", "person", ["Old Moth"])]
    assert catalogue(cast).link("SRCU") == {1, 2, 3}
    assert catalogue(cast).link("Old Moth") == {4, 5, 6}


def test_edit_distance():
    for a, b, d in [("abc", "abc", 0), ("abc", "acb", 1), ("abc", "abcd", 1), ("abcd", "bcd", 1), ("kitten", "sitting", 3), ("abc", "xyz", 3)]:
        assert names.edit_distance(a, b, 4) == d
    assert names.edit_distance("aaaaaaaa", "bbbbbbbb", 2) == 3


def test_links_of_odd_rows(spark):
    cast = spark.createDataFrame(CAST, "character_id long, full_name string, member_type string, aliases array<string>")
    s = spark.createDataFrame([(1, ["Banh Quynh Dang", "Banh Quynh Dang", None, ""]), (2, ["Bành Quỳnh Đằng"]), (3, None)], "story_row_id long, characters array<string>").withColumn("form", F.lit(1))
    c = spark.createDataFrame([(7, ["Tilly Larkspurrow"])], "chunk_row_id long, characters array<string>")
    g = spark.createDataFrame([(4, [("SRCU", None, None)]), (5, None)], "graph_id long, entities array<struct<name:string,type:string,description:string>>")
    got = {tuple(r) for r in names.variant_links(names.mentions(g, s, c), cast).collect()}
    assert got == {("stories", 1, 1), ("chunk_metadata", 7, 3), ("document_graphs", 4, 4)}
    assert names.variant_links(names.mentions(g, s, c), cast.limit(0)).count() == 0


def test_both_ways_of_the_join_agree(spark, data):
    named = queries._mentions(spark, data).select("form").distinct()
    cast = spark.read.parquet(f"{data}/cast_members.parquet")
    a, b = ({tuple(r) for r in names.link_forms(named, cast, small).collect()} for small in (names.SMALL, 10))
    assert a == b and len(a) > 100


def brute_linkage(sims, least):
    """One merge at a time, by all pairs of clusters."""
    nodes = sorted({x for p in sims for x in p})
    s = {frozenset(p): v for p, v in sims.items()}
    groups = [[x] for x in nodes]
    while True:
        best = min(((-round(sum(s.get(frozenset((x, y)), 0) for x in g for y in h) / (len(g) * len(h)), 9), g[0], h[0], i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if g[0] < h[0]), default=None)
        if best is None or -best[0] < least:
            return {x: g[0] for g in groups for x in g}
        _, _, _, i, j = best
        merged = sorted(groups[i] + groups[j])
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [merged]


def test_average_linkage_against_brute_force(spark):
    rng = random.Random(2)
    sims = {(f"n{i:02}", f"n{j:02}"): round(rng.uniform(0.5, 1), 3) for i in range(24) for j in range(i + 1, 24) if rng.random() < 0.25}
    df = spark.createDataFrame([(a, b, s) for (a, b), s in sims.items()], "a string, b string, s double")
    assert dict(map(tuple, names.average_linkage(df, 0.4).collect())) == brute_linkage(sims, 0.4)
    assert names.average_linkage(df.limit(0)).count() == 0


def test_similar_forms_against_brute_force(spark, data):
    texts = sorted({"".join(names.words_of(r.form)) for r in queries._mentions(spark, data).select("form").distinct().collect()} - {""})[:150]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    grams = {t: set(names._grams(t)) for t in texts}
    df_ = Counter(g for v in grams.values() for g in v)
    w = {g: np.log(1 + len(texts) / k) for g, k in df_.items()}
    norm = {t: np.sqrt(sum(w[g] ** 2 for g in v)) for t, v in grams.items()}
    want = {(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if round(sum(w[g] ** 2 for g in grams[a] & grams[b]) / (norm[a] * norm[b]), 9) >= 0.6}
    assert {(r.a, r.b) for r in names.similar_forms(df, 0.6).collect()} == want and want


def test_clusters_hold_every_form(spark):
    cast = spark.createDataFrame(CAST, "character_id long, full_name string, member_type string, aliases array<string>")
    forms = spark.createDataFrame([(x,) for x in ("Banh Quynh Dang", "Bành Quỳnh Đằng", "Zacharias Pomfritt", "Zacharias Pomfrit", "Mr Zacharias Pomfritt", "Isolde Quartermain", "?!", None)], "form string").filter("form is not null")
    got = {r.form: (r.cluster, r.character_id) for r in names.clusters(forms, cast).collect()}
    assert len(got) == 7 and got["Banh Quynh Dang"] == got["Bành Quỳnh Đằng"] == ("member:1", 1)
    assert len({got[x][0] for x in ("Zacharias Pomfritt", "Zacharias Pomfrit", "Mr Zacharias Pomfritt")}) == 1
    assert got["Isolde Quartermain"][0] != got["Zacharias Pomfrit"][0] and got["?!"] == ("?!", None)


# ------------------------------------------------------------------ problems 8 and 9


def test_tokens_are_those_of_the_tokenizer(spark):
    texts = ["Chú bé chăn vịt.", "", "x" * 5000, "水镜子 и лиса"]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)] + [(9, "s", None)], "doc_id long, source string, text string")
    e = tokens.encoding(tokens.TOKENIZER)
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()} == {i: len(e.encode_ordinary(t)) for i, t in enumerate(texts)}


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=6), st.integers(0, 60))
def test_fullest_against_brute_force(counts, room):
    reach = {0}
    for n, c in counts.items():
        reach = {r + k * n for r in reach for k in range(c + 1) if r + k * n <= room}
    got = packing.fullest(counts, sorted(counts, reverse=True), room)
    assert sum(n * k for n, k in got.items()) == max(reach)
    assert all(k <= counts[n] for n, k in got.items())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), min_size=1, max_size=20))
def test_plan_places_every_item_once(counts):
    bins: Counter = Counter()
    ranks: dict = {}
    for n, first, end, b0, per in packing.plan(counts, 50):
        for r in range(first, end):
            assert (n, r) not in ranks
            ranks[n, r] = b0 + (r - first) // per
            bins[ranks[n, r]] += n
    assert set(ranks) == {(n, r) for n, c in counts.items() for r in range(c)}
    assert max(bins.values()) <= 50 and set(bins) == set(range(len(bins)))


def test_packing_of_odd_rows(spark):
    rng = random.Random(2)
    sizes = [0, 0, 100, 250, 250, 1] + [rng.choice([7, 7, 7, 33, 60]) for _ in range(400)]
    counts = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, n_tokens long").withColumn("size", F.lit(1))
    windows = spark.createDataFrame([(1, 100), (2, 8192)], "window_id int, capacity_tokens int")
    rows = packing.pack(counts, windows).collect()
    for w, cap in ((1, 100), (2, 8192)):
        own = [r for r in rows if r.window_id == w]
        placed: Counter = Counter()
        for r in own:
            placed[r.doc_id] += r.n_tokens
        assert {i: placed[i] for i in range(len(sizes))} == dict(enumerate(sizes))
        load: Counter = Counter()
        for r in own:
            if r.bin_no is not None:
                load[r.bin_no] += r.n_tokens
        assert max(load.values()) <= cap and len(load) <= -(-sum(sizes) // cap) * 1.06 + 1
        assert all(r.piece_no == 0 or sizes[r.doc_id] > cap for r in own)
    assert packing.pack(counts.limit(0), windows).count() == 0 and packing.pack(counts, windows.limit(0)).count() == 0


def test_budgets():
    x, b = mixing.budgets([("a", 0.5, 1), ("b", 0.5, 4), ("gone", 0.2, 1)], {"a": 1000, "b": 400})
    assert x == 1 and b["a"][1] == pytest.approx(1000) and b["b"][1] == pytest.approx(1000)
    assert mixing.budgets([("x", 1.0, 1)], {}) == (1.0, {})
    x, w = mixing.temperature_weights({"a": 0.7, "b": 0.2, "c": 0.1}, 0.95)
    assert mixing.entropy(list(w.values())) == pytest.approx(0.95, abs=1e-6) and 0 < x < 1
    assert mixing.budgets([("a", 0.5, 1), ("b", 0.5, 1)], {"a": 700, "b": 300}, target_entropy=0.65)[0] < 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 1), st.integers(1, 6), st.integers(1, 10_000)), min_size=1, max_size=8), st.floats(0.2, 5))
def test_budgets_keep_the_limits(rows, stretch):
    targets, tokens_ = [(str(i), t, r) for i, (t, r, _) in enumerate(rows)], {str(i): n for i, (_, _, n) in enumerate(rows)}
    x, b = mixing.budgets(targets, tokens_, stretch)
    exact = sum(v for _, v in mixing.budgets(targets, tokens_)[1].values())
    limits = {s: r * tokens_[s] for s, _, r in targets}
    assert all(v <= limits[s] * (1 + 1e-9) for s, (_, v) in b.items())
    assert sum(v for _, v in b.values()) == pytest.approx(min(stretch * exact, sum(limits.values())))
    assert (x == 1) == all(w == pytest.approx(t / sum(t for _, t, _ in targets)) for (w, _), (_, t, _) in zip(b.values(), targets)) or stretch > 1


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(6)
    rows = [(i, "hot" if i % 3 == 0 else rng.choice(["b", "c", None]), rng.randrange(0, 60)) for i in range(6000)]
    counts = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").withColumn("block", F.lit(0))
    targets = spark.createDataFrame([(1, "hot", 0.2, 1), (1, "b", 0.4, 2), (1, "c", 0.4, 3), (2, "hot", 0.5, 1), (2, "none", 0.5, 9)], "mix_id int, source string, target_share double, max_repeats int")
    planned = mixing.plan(counts, targets)
    chosen = mixing.select(counts, planned)
    got = {(r.mix_id, r.source): r for r in mixing.shares(chosen, targets, planned).collect()}
    for k in ("hot", "b", "c"):
        assert got[1, k].actual_share == pytest.approx(got[1, k].target_share, abs=0.002) and got[1, k].most_copies <= got[1, k].max_repeats
    assert got[2, "none"].tokens == 0 and got[2, "hot"].actual_share == 1.0
    assert chosen.groupBy("mix_id", "doc_id").count().filter("count > 1").count() == 0
    assert mixing.select(counts.limit(0), mixing.plan(counts.limit(0), targets)).count() == 0
    wide = mixing.plan(counts, targets, stretch=2.5)
    got = mixing.shares(mixing.select(counts, wide), targets, wide).filter("mix_id = 1").collect()
    assert all(0 < r.exponent < 1 and r.most_copies <= r.max_repeats and r.actual_share == pytest.approx(r.weight, abs=0.002) for r in got)


# ------------------------------------------------------------------ problem 10


def test_items_of_unseen_patterns():
    """Trained on four fifths of the patterns, measured on the wordings of the rest."""
    patterns = [(k, p) for k, v in pii.PATTERNS.items() for p in v.split("|")]
    right = wrong = missed = 0
    for fold in range(5):
        model = pii.fitted([x for i, x in enumerate(patterns) if i % 5 != fold])
        rng = random.Random(99)
        for language, p in (x for i, x in enumerate(patterns) if i % 5 == fold):
            for _ in range(4):
                text, gold = pii._filled(rng, language, p)
                got = {(s.kind, s.start, s.end) for s in pii.items(model, text)}
                right += len(got & gold)
                wrong += len(got - gold)
                missed += len(gold - got)
    assert right / (right + wrong) > 0.85 and right / (right + missed) > 0.8, (right, wrong, missed)


def test_the_gradient_is_that_of_the_likelihood():
    spans = [pii.Span("name", 0, 5, ["a", "b"]), pii.Span("phone", 3, 9, ["a"]), pii.Span("phone", 8, 12, ["c"]), pii.Span("name", 14, 20, ["b"])]
    gold = [spans[0], spans[2], spans[3]]
    model = pii.Model()
    rng = random.Random(1)
    for k in [(s.kind, f) for s in spans for f in s.features] + [("then", f"{a}>{b}") for a in ("name", "phone") for b in ("name", "phone")]:
        model.w[k] = rng.uniform(-1, 1)
    got = model.gradient(spans, gold)[0]
    for k in list(model.w):
        w = model.w[k]
        up, down = (model.w.update({k: w + d}) or model.gradient(spans, gold)[1] for d in (1e-5, -1e-5))
        model.w[k] = w
        assert got.get(k, 0.0) == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_names_out_of_reach_change_nothing(spark, data):
    model = pii.trained()
    assert model.everywhere == (False, False) and pii.bound(model, False) <= 0 and pii.bound(model, True) <= 0
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").filter("text is not null").collect()]
    found = [[(s.kind, s.start, s.end) for s in pii.items(model, t)] for t in texts]
    model.everywhere = (True, True)
    try:
        assert [[(s.kind, s.start, s.end) for s in pii.items(model, t)] for t in texts] == found
    finally:
        model.everywhere = (False, False)


def test_items_in_a_text():
    text = "Long ago a fox of 5,300 pennies slept.\r\n\r\nTold by Ada Fernhill, who\r\nlives at 12 Bramblegate Lane, Overwick. Write to ada [at] haven [dot] test or call +44 7700 900 123. ISBN 978-0-000-11111-0."
    got = [(s.kind, text[s.start : s.end]) for s in pii.items(pii.trained(), text)]
    assert got == [("name", "Ada Fernhill"), ("address", "12 Bramblegate Lane, Overwick"), ("email", "ada [at] haven [dot] test"), ("phone", "+44 7700 900 123")]


@pytest.mark.parametrize(
    "text, want",
    [
        ("The fox slept. This copy was mailed in by Beatrix Underwood, phone 07700 900123.", [("name", "Beatrix Underwood"), ("phone", "07700 900123")]),
        ("Our neighbour Beatrix Underwood (beatrix@haven.test) remembers the end.", [("name", "Beatrix Underwood"), ("email", "beatrix@haven.test")]),
        ("The crow sang. Borrowed from the trunk of Mrs Harriet Sloe, ID AB123456C.", [("name", "Harriet Sloe"), ("identity", "AB123456C")]),
        ("Bản ghi âm do Lò Mai Sương giữ, điện thoại 0912 345 678.", [("name", "Lò Mai Sương"), ("phone", "0912 345 678")]),
        ("Ce cahier vient de Solange Brumaire, téléphone 06.12.34.56.78.", [("name", "Solange Brumaire"), ("phone", "06.12.34.56.78")]),
        ("She lives at 14 Juniper Court, Millbrook.", [("address", "14 Juniper Court, Millbrook")]),
        ("Elle habite 8, quai des Brumes, Valmont.", [("address", "8, quai des Brumes, Valmont")]),
        ("Wohnhaft Lindenufer 12, Tannau.", [("address", "Lindenufer 12, Tannau")]),
        ("Then Beatrix Underwood met the crow. Old Harriet Sloe ruled over Far Eastmere.", []),
        ("Two men walked 3 miles this way to the old hill.", []),
    ],
)
def test_items_of_other_wordings(text, want):
    assert [(s.kind, text[s.start : s.end]) for s in pii.items(pii.trained(), text)] == want


def test_redaction_of_odd_rows(spark):
    rows = [(1, "Contact a.b@c.test or call 07700 900123."), (2, None), (3, ""), (4, "x " * 50_000), (1, "Contact a.b@c.test or call 07700 900123.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start_pos", F.lit(0))
    got = {(r.doc_id, r.text) for r in pii.redacted(df).collect()}
    assert (1, "Contact [EMAIL] or call [PHONE].") in got and (2, None) in got and (3, "") in got and (4, "x " * 50_000) in got
    assert Counter(r.pii_type for r in pii.found_items(df).collect()) == {"email": 2, "phone": 2}
    assert pii.found_items(df.limit(0)).count() == 0


def test_sketch_agrees_with_similarity():
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 2**63, 800).astype(np.uint64))
    b = np.unique(np.concatenate([a[:600], rng.integers(0, 2**63, 200).astype(np.uint64)]))
    j = neardup.similarity(a, b)
    x, y = (np.frombuffer(neardup.sketch(g)[2], np.uint8) for g in (a, b))
    assert abs((x == y).mean() - j) < 0.2 and 0.5 < j < 0.7


ODD_TEXTS = ["." * 60_000, "1 " * 30_000, "“" * 20_000, "a@" * 20_000, "không một " * 8_000, "( " * 20_000, "—a " * 15_000, " \n" * 30_000, "0" * 60_000, "“a!” " * 8_000, "told by " * 8_000, "水。" * 20_000, "ก " * 20_000]


def test_very_long_odd_texts(spark, data):
    rows = [(i, t, "t", "vi", None, None, None) for i, t in enumerate(ODD_TEXTS)]
    df = spark.createDataFrame(rows, "record_id long, text string, title string, language string, metadata map<string,string>, characters array<string>, config_id int").withColumn("doc_id", F.col("record_id")).withColumn("story_row_id", F.col("record_id"))
    assert sentences.sentences(df, "record_id").count() > 0
    assert pii.found_items(df).count() >= 0
    samples = spark.read.parquet(f"{data}/language_samples.parquet")
    assert languages.identify(df, samples).count() > 0
    assert unify.unified(unify.field_values(df, df)).count() == 2 * len(ODD_TEXTS)
    configs = spark.createDataFrame([(1, 1000, 100, True)], "config_id int, max_chunk_size int, chunk_overlap int, is_default boolean")
    assert boundaries.split_oversized(boundaries.with_limits(df, "t", "record_id", configs)).count() > 500
    assert neardup.all_pairs(df).count() == 0
    assert tokens.token_counts(df.withColumn("source", F.lit("s"))).count() == len(ODD_TEXTS)
