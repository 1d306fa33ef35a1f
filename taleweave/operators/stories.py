"""Cross-story search, labels, comparison and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleweave.functions import text as T


def labels(text: Column, catalog: dict[str, list[str]]) -> Column:
    """Sorted labels of a catalogue of keywords contained in the text; the catalogue is
    a parameter of fixed size, so it is part of the expression."""
    found = lambda x: F.array(*[F.when(_any(x, keys), F.lit(label)) for label, keys in sorted(catalog.items())])
    return F.filter(T.once(T.match_key(text), found), lambda v: v.isNotNull())


def _any(x: Column, keys: list[str]) -> Column:
    got = F.lit(False)
    for k in keys:
        got = got | x.contains(k)
    return got


def story_score(query_words: Column, query_key: Column, text_words: Column, text_key: Column, title_key: Column) -> Column:
    """Shared words + covered share of the query + 1 for the whole query in the text +
    .5 in the title."""
    shared = F.size(F.array_intersect(F.array_distinct(query_words), text_words))
    n = F.size(F.array_distinct(query_words))
    return shared + F.when(n > 0, shared / n).otherwise(0.0) + F.when(text_key.contains(query_key), 1.0).otherwise(0.0) + F.when(title_key.contains(query_key), 0.5).otherwise(0.0)


def first_of_key(df: DataFrame, array: str, out: str) -> DataFrame:
    """Adds out: the elements without repetition by match key, in first order."""
    keyed = F.transform(array, lambda x: T.match_key(x))
    firsts = F.filter(F.transform(F.sequence(F.lit(0), F.size(array) - 1), lambda i: F.when(F.array_position(keyed, F.get(keyed, i)) == i + 1, F.get(F.col(array), i))), lambda x: x.isNotNull())
    return df.withColumn(out, F.when(F.size(array) > 0, firsts).otherwise(F.array().cast("array<string>")))


def compare_sets(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(shared, only a, only b), sorted; null counts as empty."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    return F.sort_array(F.array_intersect(a, b)), F.sort_array(F.array_except(a, b)), F.sort_array(F.array_except(b, a))


def classify(text: Column, categories: dict[str, list[str]], default: str = "chung", head: int | None = None) -> Column:
    """The category of most pattern hits, ties by the order given; default for none."""
    t = F.lower(text if head is None else F.substring(text, 1, head))
    hits = [sum((F.regexp_count(t, F.lit(p)) for p in ps), F.lit(0)) for ps in categories.values()]
    best = F.greatest(*hits) if len(hits) > 1 else hits[0]
    out = F.lit(default)
    for name, h in reversed(list(zip(categories, hits))):
        out = F.when((h == best) & (best > 0), name).otherwise(out)
    return F.coalesce(out, F.lit(default))


def last_by_id(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last written row of each id."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def capitalised_names(text: Column, limit: int | None = None) -> Column:
    """Distinct runs of one to four capitalised words."""
    found = F.regexp_extract_all(text, F.lit(r"\p{Lu}[\p{L}'’]+(?: \p{Lu}[\p{L}'’]+){0,3}"), F.lit(0))
    out = F.array_distinct(F.filter(found, lambda x: F.length(x) > 1))
    return out if limit is None else F.slice(out, 1, limit)


def found_labels(stories_: DataFrame, query: Column | str, catalog: dict[str, list[str]], score: Column, min_score: float = 0.0) -> DataFrame:
    """Adds matched (labels of both the query and the story text) and boosted: the score,
    with 2 and the number of matches if there are any; keeps what is above min_score."""
    q = F.lit(query) if isinstance(query, str) else query
    own = F.array_intersect(labels(F.col("text"), catalog), labels(q, catalog))
    x = stories_.withColumn("matched", own)
    return x.withColumn("boosted", score + F.when(F.size("matched") > 0, 2.0 + F.size("matched")).otherwise(0.0)).filter(F.col("boosted") > min_score)


# Words before the name of a place, without accents, and signs of a Vietnamese text.
PLACES = "nui|song|bien|hang|lang|kinh do|vuong quoc"
VIETNAMESE_TERMS = ("thach", "sanh", "tam", "cam", "vua", "cong chua")
VIETNAMESE_SIGNS = "àáảãạăắằẳẵặâấầẩẫậđèéẻẽẹêếềểễệòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữự"


def location_phrases(text: Column) -> Column:
    """Distinct phrases of a word for a place and the next word, without accents, in the
    order of their first place."""
    return F.array_distinct(F.regexp_extract_all(T.strip_diacritics(text), F.lit(rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{PLACES})\s+[a-zA-Z]+"), F.lit(0)))


def built_language(text: Column) -> Column:
    """vi for a text with a Vietnamese letter or one of a few terms, else unknown."""
    low = F.lower(text)
    return F.when(low.rlike(f"[{VIETNAMESE_SIGNS}]") | _any(low, list(VIETNAMESE_TERMS)), "vi").otherwise("unknown")


def built_records(texts: DataFrame, motifs: dict[str, list[str]]) -> DataFrame:
    """(story_id, title, text, motifs, language, word_count) of stories (title, text): the
    text cleaned and composed, the id a hash of both."""
    x = texts.select(F.coalesce("title", F.lit("")).alias("title"), F.coalesce(T.cleaned(T.composed(F.col("text"))), F.lit("")).alias("text"))
    return x.select(F.substring(F.sha1(F.concat_ws("\n", "title", "text")), 1, 16).alias("story_id"), "title", "text", labels(F.col("text"), motifs).alias("motifs"), built_language(F.col("text")).alias("language"), F.regexp_count("text", F.lit(r"[^ \t\n\r\f]+")).alias("word_count"))
