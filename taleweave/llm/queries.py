"""The registered queries of this package."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from taleweave.llm import boundaries, cooccur, languages, mixing, names, neardup, packing, pii, sentences, tokens, unify
from taleweave.session import load


def _oversized(spark, d):
    configs = load(spark, d, "chunking_configs")
    tales = boundaries.with_limits(load(spark, d, "fairy_tales"), "fairy_tales", "record_id", configs)
    return tales.unionByName(boundaries.with_limits(load(spark, d, "stories"), "stories", "story_row_id", configs))


def p1_found(spark, d):
    """Rows of which the operator made several pieces."""
    return boundaries.split_oversized(_oversized(spark, d), with_text=False).filter("piece_no = 0").select("src", "row_id")


def p1_pieces(spark, d):
    return boundaries.split_oversized(_oversized(spark, d))


def p1_check(spark, d):
    """What the pieces of every oversized text hold: the text, rebuilt without the
    overlaps, all within the limit."""
    rows = _oversized(spark, d)
    pieces = boundaries.split_oversized(rows)
    kept = F.array_sort(F.collect_list(F.struct("piece_no", "start_pos", "piece_text")))
    g = pieces.groupBy("src", "row_id").agg(kept.alias("p"), F.max(F.length("piece_text")).alias("longest"))
    new = F.transform("p", lambda x, i: F.substring(x["piece_text"], F.when(i == 0, 1).otherwise(F.get(F.col("p"), i - 1)["start_pos"] + F.length(F.get(F.col("p"), i - 1)["piece_text"]) - x["start_pos"] + 1), F.length(x["piece_text"])))
    limits = rows.groupBy("src", "row_id").agg(F.max("limit").alias("limit"))
    return g.join(limits, ["src", "row_id"]).select("src", "row_id", F.md5(F.array_join(new, "")).alias("text_md5"), (F.col("longest") <= F.col("limit")).alias("within"))


def p2_found(spark, d):
    return cooccur.pairs(load(spark, d, "stories"), min_lift=3.0).select("item_a", "item_b")


def p2_pairs(spark, d):
    """Pairs of the support of p2_found, of any lift."""
    return cooccur.pairs(load(spark, d, "stories"))


def p2_all_pairs(spark, d):
    """Every pair that occurs in a story."""
    return cooccur.pairs(load(spark, d, "stories"), min_support=1, min_share=0)


def _values(spark, d):
    return unify.field_values(load(spark, d, "stories"), load(spark, d, "fairy_tales"))


def p3_found(spark, d):
    return unify.affected(_values(spark, d))


def p3_unified(spark, d):
    return unify.unified(_values(spark, d))


def p3_check(spark, d):
    """What is left to unify in the unified values, and what they keep: none, one row each."""
    x = unify.unified(_values(spark, d))
    again = unify.affected(x.withColumnRenamed("canonical", "value").drop("changed")).groupBy("src", "field_name").agg(F.count("*").alias("left"))
    n = x.groupBy("src", "field_name").agg(F.count("*").alias("n"))
    return n.join(again, ["src", "field_name"], "left").na.fill(0, ["left"])


def p4_found(spark, d):
    return languages.identify(load(spark, d, "fairy_tales"), load(spark, d, "language_samples"), found_only=True)


def p4_segments(spark, d):
    return languages.identify(load(spark, d, "fairy_tales"), load(spark, d, "language_samples"))


def p5_found(spark, d):
    return neardup.all_pairs(load(spark, d, "fairy_tales"))


def p5_pairs(spark, d):
    return neardup.near_duplicates(load(spark, d, "fairy_tales"))[0].withColumn("similarity", F.round("similarity", 6))


def p5_groups(spark, d):
    return neardup.groups(load(spark, d, "fairy_tales"))


def p6_found(spark, d):
    return sentences.sentences(load(spark, d, "fairy_tales"), "record_id", with_text=False).select("record_id", "start_pos")


def p6_sentences(spark, d):
    return sentences.sentences(load(spark, d, "fairy_tales"), "record_id")


def p6_check(spark, d):
    """The characters of every text in the order of its sentences, without white space."""
    x = sentences.sentences(load(spark, d, "fairy_tales"), "record_id").groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("sentence_no", "sentence"))).alias("s"))
    return x.select("record_id", F.md5(F.regexp_replace(F.array_join(F.transform("s", lambda v: v["sentence"]), ""), r"[ \t\r\n\f]+", "")).alias("text_md5"))


def _mentions(spark, d):
    return names.mentions(load(spark, d, "document_graphs"), load(spark, d, "stories"), load(spark, d, "chunk_metadata"))


def p7_found(spark, d):
    return names.variant_links(_mentions(spark, d), load(spark, d, "cast_members"))


def p7_forms(spark, d):
    return names.link_forms(_mentions(spark, d), load(spark, d, "cast_members"))


def p7_clusters(spark, d):
    return names.clusters(_mentions(spark, d), load(spark, d, "cast_members"))


def p7_aliases(spark, d):
    """Links of the forms written as an alias of the catalogue is."""
    cast = load(spark, d, "cast_members")
    aliases = cast.select(F.explode("aliases").alias("form"), F.col("character_id").alias("owner"))
    return p7_forms(spark, d).join(aliases, "form").filter("character_id = owner").select("form", "character_id")


def p8_packing(spark, d):
    return packing.pack(tokens.token_counts(load(spark, d, "documents")), load(spark, d, "pack_windows"))


def p8_fill(spark, d):
    return packing.fill(p8_packing(spark, d), load(spark, d, "pack_windows"))


def p8_check(spark, d):
    """What holds of the whole packing."""
    counts = tokens.token_counts(load(spark, d, "documents"))
    windows = load(spark, d, "pack_windows")
    return packing.checked(packing.pack(counts, windows), counts, windows).drop("n_tokens")


def _mixed(spark, d, stretch=1.0):
    counts, targets = tokens.token_counts(load(spark, d, "documents")), load(spark, d, "mix_targets")
    planned = mixing.plan(counts, targets, stretch)
    return mixing.select(counts, planned), targets, planned


def p9_mixture(spark, d):
    return _mixed(spark, d)[0]


def p9_shares(spark, d):
    return mixing.shares(*_mixed(spark, d))


def p9_stretched(spark, d):
    """Shares at twice the size at which all targets can be met: the exponent falls to
    what the repetition limits allow."""
    return mixing.shares(*_mixed(spark, d, 2.0))


def p9_check(spark, d):
    """What holds of every mix: the shares reached to within a document and a tenth of a
    percent, no document above its limit, the exponent bisected to 1."""
    chosen, targets, planned = _mixed(spark, d)
    longest = chosen.groupBy("mix_id").agg(F.max("n_tokens").alias("longest"))
    x = mixing.shares(chosen, targets, planned).join(longest, "mix_id", "left")
    have = F.sum(F.when(F.col("weight") > 0, F.col("target_share"))).over(Window.partitionBy("mix_id"))
    x = x.withColumn("due", F.when(F.col("weight") > 0, F.col("target_share") / have).otherwise(0.0))
    return x.select("mix_id", "source", (F.abs(F.col("actual_share") - F.col("due")) <= 0.001 + F.coalesce(F.col("longest") / F.sum("tokens").over(Window.partitionBy("mix_id")), F.lit(0.0))).alias("reached"), (F.col("most_copies") <= F.col("max_repeats")).alias("within"), (F.coalesce("exponent", F.lit(1.0)) == 1).alias("at_target"))


def p10_found(spark, d):
    return pii.found_items(load(spark, d, "documents")).select("doc_id", "pii_type", "start_pos")


def p10_redacted(spark, d):
    return pii.redacted(load(spark, d, "documents"))


def p10_check(spark, d):
    """Plain e-mail addresses of every document that were found, and those that are left."""
    docs = load(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    plain = r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
    found = pii.found_items(docs).filter("pii_type = 'email'").join(docs, "doc_id").filter(F.expr("substring(text, start_pos, end_pos - start_pos + 1)").rlike(f"^{plain}$"))
    n = found.groupBy("doc_id").agg(F.count("*").alias("n_found"))
    left = pii.redacted(docs).select("doc_id", F.regexp_count("text", F.lit(plain)).cast("long").alias("n_left"))
    return left.join(n, "doc_id", "left").select("doc_id", F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"), "n_left")


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_check, p2_found, p2_pairs, p2_all_pairs, p3_found, p3_unified, p3_check, p4_found, p4_segments, p5_found, p5_pairs, p5_groups, p6_found, p6_sentences, p6_check, p7_found, p7_forms, p7_clusters, p7_aliases, p8_packing, p8_fill, p8_check, p9_mixture, p9_shares, p9_stretched, p9_check, p10_found, p10_redacted, p10_check)}
