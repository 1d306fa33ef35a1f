"""Scalar text functions as Column expressions; only canonical composition leaves the JVM.

All of them give null for null and the empty string for an empty one unless said
otherwise, and keep extra columns untouched as they are plain expressions.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType



def _bases(compatible: bool) -> dict[str, str]:
    """Letters of the basic plane that decompose to one letter and marks, with that
    letter; with compatible also those whose form alone differs (full width, raised)."""
    out = {}
    for o in (*range(0xA0, 0x1100), *range(0x1E00, 0x2500), *range(0x3000, 0x3100), *range(0xFF00, 0xFFF0)):
        parts = unicodedata.normalize("NFKD" if compatible else "NFD", chr(o))
        base = "".join(ch for ch in parts if not unicodedata.combining(ch))
        if len(base) == 1 and base != chr(o):
            out[chr(o)] = base
    return out


def _class(test) -> str:
    """A character class of the basic plane's characters that pass the test, by ranges."""
    runs: list[list[int]] = []
    for o in range(0x300, 0xFFFF):
        if not 0xD800 <= o < 0xE000 and test(chr(o)):
            if runs and runs[-1][1] == o - 1:
                runs[-1][1] = o
            else:
                runs.append([o, o])
    return "[" + "".join(f"\\u{a:04x}" if a == b else f"\\u{a:04x}-\\u{b:04x}" for a, b in runs) + "]"


_FOLDED = _bases(False) | {"đ": "d"}
_STRIPPED = _bases(True) | {"đ": "d", "Đ": "D"}
FOLD_FROM, FOLD_TO = "".join(_FOLDED), "".join(_FOLDED.values())
STRIP_FROM, STRIP_TO = "".join(_STRIPPED), "".join(_STRIPPED.values())
#: Characters that combine with the one before.
COMBINING = _class(lambda ch: unicodedata.combining(ch) != 0)
VIETNAMESE_LETTERS = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
WORD = r"[\p{L}\p{N}_]+"
#: White space of any script.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def once(value: Column, use) -> Column:
    """use(value), where the value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def lower_folded(c: Column) -> Column:
    """Case folded: lower case, ß as ss."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def fold(c: Column) -> Column:
    """Without accents and case, composed or not; equal for a Vietnamese text and its
    plain typing. Non-spacing marks go, also those that are vowels of Indic scripts."""
    return F.regexp_replace(F.translate(lower_folded(c), FOLD_FROM, FOLD_TO), r"\p{Mn}", "")


def has_diacritics(c: Column) -> Column:
    return fold(c) != lower_folded(c)


def strip_diacritics(c: Column) -> Column:
    """Without accents, composed or not, case kept; compatibility forms of one letter plain."""
    for whole, parts in (("ำ", "\u0e4d\u0e32"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        c = F.replace(c, F.lit(whole), F.lit(parts))
    x = F.translate(c, STRIP_FROM, STRIP_TO)
    # the class of marks is long, so texts without any mark are spared it
    return once(x, lambda v: F.when(v.rlike(r"\p{M}"), F.regexp_replace(v, COMBINING, "")).otherwise(v))


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def composed(c: Column) -> Column:
    """Canonical composition, for which SQL has no function. Only texts with something to
    compose go through Python; for the others it gets nulls."""
    return F.coalesce(_nfc(F.when(c.rlike(r"[\p{M}\u1100-\u11ff\u2126\u212a\u212b\uf900-\ufaff]"), c)), c)


def match_key(c: Column) -> Column:
    """Letters and digits without accents and case, one space between words."""
    return F.trim(F.regexp_replace(F.lower(F.trim(strip_diacritics(c))), r"[^\p{L}\p{N}]+", " "))


def stripped(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def normal(c: Column) -> Column:
    """Composed, case folded, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(lower_folded(composed(c)), SPACE, " "))


def cleaned(c: Column) -> Column:
    """Line ends unified, runs of spaces and of blank lines reduced, trimmed."""
    x = F.regexp_replace(c, r"\r\n?", "\n")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    return stripped(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def scanned(c: Column) -> Column:
    """Scanner residue: hyphen breaks joined, invisible and no-break spaces plain,
    lines trimmed, at most one blank line."""
    x = F.regexp_replace(c, r"\r\n?", "\n")
    x = F.translate(x, " ​﻿", " ")
    x = F.regexp_replace(x, r"(\p{L})-\n(\p{Ll})", "$1$2")
    x = F.regexp_replace(x, r"[ \t]*\n[ \t]*", "\n")
    return stripped(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def words(c: Column) -> Column:
    """Array of lower-case words; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def folded_words(c: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(fold(c), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def language_by_letters(c: Column) -> Column:
    """vi above 5 % Vietnamese letters, mixed above 1 %, else en; unknown without letters."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    share = F.regexp_count(F.lower(c), F.lit(f"[{VIETNAMESE_LETTERS}]")) / letters
    return F.when(F.coalesce(letters, F.lit(0)) == 0, "unknown").when(share > 0.05, "vi").when(share > 0.01, "mixed").otherwise("en")


def source_key(path: Column) -> Column:
    """File stem of a path with either separator, empty for null."""
    return F.coalesce(F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1), F.lit(""))


# Phrases that say that nothing was found.
ABSTENTIONS = (
    "không có đủ thông tin", "không đủ thông tin", "không có thông tin", "không tìm thấy thông tin", "chưa có thông tin", "không được đề cập", "không đề cập", "không được nhắc",
    "don't have enough information", "do not have enough information", "not enough information",
)


def is_abstention(c: Column) -> Column:
    n = F.replace(normal(c), F.lit("’"), F.lit("'"))
    out = F.lit(False)
    for p in ABSTENTIONS:
        out = out | n.contains(p)
    return F.coalesce(out, F.lit(False))


def citations(c: Column) -> Column:
    """Distinct cited source labels (S1, S2, ...) in the order of their numbers."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"\[(S\d+)\]"), F.lit(1)))
    return F.array_sort(found, lambda a, b: F.substring(a, 2, 10).cast("int") - F.substring(b, 2, 10).cast("int"))


def excerpt(c: Column, limit: int = 240) -> Column:
    """At most limit characters: a longer text is cut to limit - 1 and marked."""
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit - 1)), F.lit("..."))).otherwise(c)


def unfenced(c: Column) -> Column:
    """Without an outer code fence."""
    return F.trim(F.regexp_replace(F.trim(c), r"^```[A-Za-z]*\n|\n?```$", ""))


#: Characters per token by language, for estimates.
PER_TOKEN = {"en": 4.0, "vi": 3.0, "zh": 1.5}


def estimated_tokens(c: Column, language: Column) -> Column:
    rate = F.lit(3.5)
    for k, v in PER_TOKEN.items():
        rate = F.when(language == k, v).otherwise(rate)
    return F.ceil(F.length(c) / rate)


def truncated_tail(c: Column, max_tokens: int, per_token: float = 3.5) -> Column:
    """The last part that fits an estimated number of tokens."""
    keep = int(max_tokens * per_token * 0.95)
    return F.when(F.length(c) > keep, F.substring(c, -keep, keep)).otherwise(c)


def clock(seconds: Column) -> Column:
    """Seconds as MM:SS."""
    s = seconds.cast("int")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("int"), F.pmod(s, F.lit(60)))


def safe_name(c: Column) -> Column:
    """A file name without folders and odd characters."""
    return F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"[^A-Za-z0-9._-]", "_")


def first_heading(c: Column) -> Column:
    """The title after the first '# ' at the start of a line, null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(c, r"(?m)^# (.*)$", 1)), F.lit(""))


def parsed_grade(reply: Column) -> tuple[Column, Column]:
    """('relevant' score, reason) of a reply 'score: reason'; .5 where unreadable."""
    score = F.coalesce(F.try_to_number(F.regexp_extract(reply, r"^\s*([01](?:\.\d+)?)\s*:", 1), F.lit("9.99")).cast("double"), F.lit(0.5))
    return score, F.trim(F.regexp_extract(reply, r":\s*(.*)$", 1))
