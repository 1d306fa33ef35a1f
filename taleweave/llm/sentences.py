"""Problem 6: sentence boundaries across languages and scripts.

All in SQL expressions, without a shuffle. One chain of replacements masks the
full stops of decimals, addresses, initials and abbreviations and the terminators
inside quotations, dialogue and brackets with private-use characters of the same
length, and inserts a mark after every boundary by terminator patterns of the
scripts. The text is split at the marks; as masks keep the length, positions are
those of the text itself and a sentence is restored as its substring.

Defined results: a null text gives no rows, an empty or blank one neither; a
heading or a paragraph without any ending is one sentence; repeated rows are split
each for itself; private-use characters already in a text count as letters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Abbreviations after which no sentence ends.
ABBREVIATIONS = (
    "TP TS ThS Th PGS GS BS KS P "  # Vietnamese
    "Mr Mrs Ms Dr St Capt Prof Rev Gen Col Lt cf "  # English
    "M Mme Mlle MM Mgr "  # French
    "Hr Fr vgl bzw Str "  # German
    "Sr Sra Srta D Dña Ud Uds "  # Spanish
    "см проф акад ул тел г-н г-жа "  # Russian
    "रु प्रो डॉ श्री पृ सं "  # Hindi
    "พ.ศ ค.ศ น.ส ด.ช ด.ญ ดร"  # Thai
).split()
# Those after which none ends if a number follows.
NUMBERED = (
    "Q q t tr No Nos vol vols p pp fig ch ed art chap cap Nr Bd Abb Kap S ca pág págs núm núms стр кн гл рис"
).split()
#: Month names after which a day with a full stop stands in German.
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()

# Private-use characters: opening quotation, opening quotation that is introduced
# by a colon or comma, closing one, masked terminators, boundary mark.
OPEN, SAID, CLOSE, MARK = "\ue000", "\ue001", "\ue002", "\ue003"
STOP, INNER = "\ue004", "\ue005"
_Q = f"{OPEN}{SAID}{CLOSE}{MARK}"
_LOWER = r"(?:\p{Ll}|[—–-]\s*\p{Ll})"

_TERMS = ".!?…。！？।"
#: (pattern, replacement), applied in this order. Every pattern begins with the
#: characters it is about and looks behind afterwards, so that other positions cost
#: one comparison.
STEPS: list[tuple[str, str]] = [
    ("[-]", ""),
    # blank lines always end a sentence
    (r"(\r?\n[ \t]*\r?\n\s*)", f"$1{MARK}"),
    # quotation marks by their place: „ “ opens in German what “ closes
    (r"“(?=[\s,.;:!?)—–]|$)", CLOSE),
    (r"([:：,，]\s*)[“„«‘「『\"](?=\s?[^\s])", f"$1{SAID}"),
    (r"[“„«‘「『]", OPEN),
    (r"[”»」』]|’(?=[\s,.;:!?)]|$)", CLOSE),
    (r"\"(?:(?<![^\s(\[—–" + MARK + r"]\")(?=[^\s])|(?<=[.!?…]\")(?=\p{Lu}))", OPEN),
    (r"\"", CLOSE),
    # addresses, spaced letters, initials, abbreviations, days before months
    (r"[.?!](?=[^\s])(?<=(?:https?://|www\.)[^\s]{0,80}[.?!])", STOP),
    (r"\.(?=\s?\p{L}\.)(?<=(?<![\p{L}\p{M}])\p{L}\.)", STOP),
    (
        r"\.(?:(?=\s?[^\s])(?<=(?<![\p{L}\p{M}\p{N}])(?:\p{Lu}|[ap][." + STOP + r"]\s?m)\.)"
        + r"|(?<=(?<![\p{L}\p{M}\p{N}])(?:" + "|".join(a.replace(".", "[." + STOP + "]") for a in ABBREVIATIONS) + r")\.)"
        + r"|(?=\s*\p{N})(?<=(?<![\p{L}\p{M}\p{N}])(?:" + "|".join(NUMBERED) + r")\.)"
        + r"|(?=\s+(?:" + "|".join(MONTHS) + r")\b)(?<=(?<!\p{N})\p{N}{1,2}\.))",
        STOP,
    ),
    # terminators inside quotations, brackets and dialogue between dashes: a match
    # begins at an opening sign that is closed, or where the last match ended
    (rf"((?:[{OPEN}{SAID}](?=[^{_Q}]*+{CLOSE})|(?!^)\G)[^{_Q}{_TERMS}]*+)[{_TERMS}]", f"$1{INNER}"),
    (rf"((?:[(（](?=[^()（）{MARK}]*+[)）])|(?!^)\G)[^()（）{MARK}{_TERMS}]*+)[{_TERMS}]", f"$1{INNER}"),
    (rf"((?:—(?=[^\s][^—{MARK}]*+(?<=\s)—\p{{Ll}})|(?!^)\G)[^—{MARK}{_TERMS}]*+)[{_TERMS}]", f"$1{INNER}"),
    # an introduced quotation that ends in a terminator ends its sentence
    (rf"({SAID}[^{_Q}]*+(?<={INNER}\s?){CLOSE})(?=\s+(?!{_LOWER})[^\s]|[^\s\p{{P}}\p{{Ll}}{OPEN}]|{OPEN})", f"$1{MARK}"),
    (rf"({OPEN}[^{_Q}]*+(?<={INNER}\s?){CLOSE})(?=\s+(?:\p{{Lu}}|[{OPEN}{SAID}¿¡]))", f"$1{MARK}"),
    # terminators of the scripts with what closes after them
    (
        rf"([.!?…।](?<![.!?…।]{{2}})[.!?…।]*+[\])）{CLOSE}]*+)(?=\s+(?!{_LOWER}|[,;:])[^\s])|([.!?।](?<![.!?।]{{2}})[.!?।]{{0,2}}+)(?<=[\p{{Ll}}\p{{M}}\p{{Lo}}\p{{N}}\]){CLOSE}][.!?।]{{1,3}})(?=\p{{Lu}}[\p{{Ll}}\s]|[{OPEN}¿¡])"
        rf"|([。！？]++[{CLOSE}）]*+)(?=[^。！？{CLOSE}）{MARK}])",
        f"$1$2$3{MARK}",
    ),
    # a space ends a Thai sentence unless a numeral or the repetition mark is beside it
    (rf"([ \n])(?=[\p{{IsThai}}{OPEN}(])(?![๐-๙ๆ])(?<=[\p{{IsThai}}{CLOSE})][ \n])(?<![๐-๙ๆ][ \n])", f"$1{MARK}"),
]


#: Characters or strings without which a step changes nothing, by its place in STEPS;
#: steps that are not named here always run.
_QUOTES = ("“", "„", "«", "‘", "「", "『")
GUARDS: dict[int, tuple[str, ...]] = {
    0: tuple("\ue000\ue001\ue002\ue003\ue004\ue005"), 1: ("\n",), 2: ("“",), 3: (*_QUOTES, '"'), 4: _QUOTES, 5: ("”", "»", "」", "』", "’"), 6: ('"',), 7: ('"',), 8: ("http", "www."),
    11: (OPEN, SAID), 12: ("(", "（"), 13: ("—",), 14: (SAID,), 15: (OPEN,),
}


def marked(text: Column) -> Column:
    """The text with masks and with a mark after every boundary."""
    for i, (pattern, replacement) in enumerate(STEPS):
        if i in GUARDS:
            # the lambda binds the text once, however often it is named
            def step(v: Column, i=i, pattern=pattern, replacement=replacement) -> Column:
                held = reduce(lambda a, b: a | b, (v.contains(g) for g in GUARDS[i]))
                return F.when(held, F.regexp_replace(v, F.lit(pattern), F.lit(replacement))).otherwise(v)

            text = F.get(F.transform(F.array(text), _one(step)), F.lit(0))
        else:
            text = F.regexp_replace(text, F.lit(pattern), F.lit(replacement))
    return text


def _one(f):
    """f as a function of one argument, as those of two get the position too."""
    return lambda v: f(v)


#: Segments whose lengths are summed at once; sums of blocks keep long texts linear.
BLOCK = 128

# Each value is bound by a lambda over a one-element array, as a projection that is
# collapsed into a lambda would be evaluated for every segment.
_SPANS = f"""
transform(array(parts_of), parts ->
  transform(array(transform(parts, s -> length(s))), sizes ->
    transform(array(transform(sequence(0, (size(sizes) - 1) div {BLOCK}), b -> aggregate(slice(sizes, 1, b * {BLOCK}), 0, (a, x) -> a + x))), blocks ->
      {{inner}}
    )[0])[0])[0]
"""
_START = f"aggregate(slice(sizes, cast((i div {BLOCK}) * {BLOCK} + 1 as int), i % {BLOCK}), blocks[cast(i div {BLOCK} as int)], (a, x) -> a + x) + 1 + length(s) - length(ltrim(' \t\r\n\f', s))"
_LENGTH = "length(trim(BOTH ' \t\r\n\f' FROM s))"
_PLACES = f"filter(transform(parts, (s, i) -> struct({_START} as start_pos, {_LENGTH} as n_chars)), x -> x.n_chars > 0)"
# A sentence is cut from the text of its block, so that the way to it is short, and here, so
# that the text does not travel with every sentence.
_RESTORED = f"""
transform(array(transform(blocks, (o, b) -> substring(text, o + 1, coalesce(get(blocks, b + 1), 2147483647) - o))), texts ->
  filter(transform(parts, (s, i) -> transform(array(struct({_START} as p, {_LENGTH} as n)), at ->
    struct(at.p as start_pos, at.n as n_chars, substring(texts[cast(i div {BLOCK} as int)], at.p - blocks[cast(i div {BLOCK} as int)], at.n) as sentence))[0]), x -> x.n_chars > 0))[0]
"""


def sentences(df: DataFrame, id_col: str, with_text: bool = True) -> DataFrame:
    """(id, sentence_no, start_pos, n_chars[, sentence]); start_pos counts code
    points from 1 and is that of the first character that is no white space."""
    kept = [F.col(id_col), *([F.col("text")] if with_text else [])]
    parts = df.filter("text is not null").select(*kept, F.split(marked(F.col("text")), MARK).alias("parts_of"))
    spans = parts.select(F.col(id_col), F.expr(_SPANS.format(inner=_RESTORED if with_text else _PLACES)).alias("spans"))
    # outer: else the optimizer evaluates the generator's input a second time in a filter
    out = spans.select(F.col(id_col), F.posexplode_outer("spans").alias("sentence_no", "span")).filter("span is not null")
    return out.select(F.col(id_col), "sentence_no", "span.start_pos", "span.n_chars", *(["span.sentence"] if with_text else []))
