"""Problem 3: visually identical text with different characters.

Values are screened in the JVM by one character class; only suspect values (with
a compatibility form, combining accent, invisible or odd space character, or with
letters of several alphabets) are mapped by the look-alike tables, once. The mapped
values and the clean values that may look like them are grouped together under the
accent-sensitive collation UNICODE in SQL; the canonical member of a class is its
least clean one in code point order, or its least mapped form if it has none, and it
is joined back by value. Clean values meet a class by the hash of their ASCII letters,
digits and signs, which equal forms share; the others are the only member of their
class, pass unchanged and are not shuffled.

Whole words of another alphabet stay: a letter is exchanged only inside a word
that mixes alphabets, or in a word of look-alikes alone whose neighbours are all
of the other alphabet. Chinese and Japanese full-width punctuation and spaces,
Hindi and Thai signs, and joiners between Indic letters stay.

Defined results: null values give no row, empty ones come out empty; equal values
are mapped once and joined back to every row; field positions start at 1.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from taleweave.session import cut, small_side

#: Hashes of mapped forms up to which clean values are looked up by a broadcast (8 bytes each).
KEYS = 2_000_000

# Look-alike letters, Latin to Cyrillic and Greek, in pairs.
CYRILLIC_LATIN = dict(zip("АВЕЅІЈКМНОРСТУХЗаеѕіјорсухһԁԛԝ", "ABESIJKMHOPCTYX3aesijopcyxhdqw"))
GREEK_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυικτ", "ABEZHIKMNOPTYXavopuikt"))
LATIN_CYRILLIC = dict(zip("ABEKMHOPCTYXaeopcyxkmt", "АВЕКМНОРСТУХаеорсухкмт"))
LATIN_GREEK = dict(zip("ABEZHIKMNOPTYXvo", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνο"))
INVISIBLE = "\u0000-\u0008\u000e-\u001f\u007f-\u0084\u0086-\u009f\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2065-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
ODD_SPACE = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f"
VIETNAMESE_ETH = {"Ð": "Đ", "ð": "đ", "Ɖ": "Đ"}

#: Java class of characters that may need mapping.
SUSPECT = (
    "[\u0000-\u0008\u000e-\u001f\u007f-\u0084\u0086-\u009f\u00adÐðƉ\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202f\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\\x{1bca0}-\\x{1bca3}\\x{e0000}-\\x{e0fff}\u00a0\u1680\u2000-\u200a\u205f\u3000"
    "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff⺀-\u2fdf豈-\ufaffﬀ-ﭏ＇０-９Ａ-Ｚａ-ｚ･-ﾟ\u3099\u309a"
    "℀-⅏①-⓿\\x{1d400}-\\x{1d7ff}\\x{2f800}-\\x{2fa1f}Ͱ-Ͽἀ-\u1fff\u0e4dıȷɡɑ\u0958-\u095f]"
)
#: Full-width punctuation, and a line that holds it without Chinese, Japanese or Korean letters.
WIDE = "[！-／：-＠［-｀｛-～]"
WIDE_LINE = r"(?dm)^[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\n]*" + WIDE + r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\n]*$"

_COMPAT = re.compile("[℀-⅏①-⓿⺀-\u2fdf豈-\ufaffﬀ-ﭏ＇０-９Ａ-Ｚａ-ｚ･-ﾟ\U0001d400-\U0001d7ff\U0002f800-\U0002fa1f]+")
_TOKEN = re.compile(r"[^\W_]+")
_CJK = re.compile("[⺀-鿿\uff00-｠\U00020000-\U0003ffff]")
_JOINER = re.compile("(?<![\u0900-\u0dff])[\u200c\u200d]|[\u200c\u200d](?![\u0900-\u0dff])")
_IDEOGRAPHIC_SPACE = re.compile("\u3000")
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_ODD_SPACE = re.compile(f"[{ODD_SPACE}]")
_FULL_WIDTH = re.compile(f"{WIDE}+")
_CJK_LETTER = re.compile("[\u1100-\u11ff⺀-⿟々〆〇ぁ-ヿㄅ-ㆎㆠ-ㇿ㐀-鿿가-\ud7ff豈-\ufaffｦ-\uffdc\U00020000-\U0003ffff]")
_SARA_AM = re.compile("\u0e4d([\u0e48-\u0e4b]?)\u0e32")
# Letters that look like plain Latin ones: kept in phonetic words and in Turkish values.
LATIN_ODD = {"ı": "i", "ȷ": "j", "ɡ": "g", "ɑ": "a"}
_ODD_WORD = re.compile(r"\S*[ıȷɡɑ]\S*")
_PHONETIC = re.compile(r"[ɐɒ-ɟɢ-ʯˈˌː]|^\W*(?:/[^/]+/|\[[^\]]+\])\W*$")
_TURKISH = re.compile("[ğĞşŞİ]")
_VIETNAMESE = re.compile("[ăđơưạ-ỹĂĐƠƯẠ-Ỹ]")


def _alphabets(word: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for ch in word:
        o = ord(ch)
        k = "L" if ch.isalpha() and (o < 0x250 or 0x1E00 <= o < 0x1F00) else "C" if 0x400 <= o < 0x530 else "G" if 0x370 <= o < 0x400 else ""
        if k:
            out[k] = out.get(k, 0) + 1
    return out


_TO_LATIN = CYRILLIC_LATIN | GREEK_LATIN | LATIN_ODD
_TABLES = {"L": _TO_LATIN, "C": LATIN_CYRILLIC | {g: LATIN_CYRILLIC[x] for g, x in GREEK_LATIN.items() if x in LATIN_CYRILLIC}, "G": LATIN_GREEK}


def look_alikes(text: str) -> str:
    """Letters of look-alike alphabets mapped to the alphabet of their word."""
    words = [(m.start(), m.group()) for m in _TOKEN.finditer(text)]
    kinds = [_alphabets(w) for _, w in words]
    if len({k for x in kinds for k in x}) < 2:
        return text
    out, at = [], 0
    for i, (start, word) in enumerate(words):
        have, to = kinds[i], ""
        if len(have) > 1:
            # letters that have no look-alike tell the alphabet of the word
            sure = {k: sum(1 for ch in word if k in _alphabets(ch) and not any(ch in _TABLES[t] for t in have if t != k)) for k in have}
            to = max(have, key=lambda k: (sure[k], have[k], k == "L"))
        elif have:
            own = next(iter(have))
            near = [next(iter(kinds[j])) for j in (i - 1, i + 1) if 0 <= j < len(words) and len(kinds[j]) == 1 and words[j][1].isalpha()]
            other = set(near) - {own}
            if len(near) >= 1 and len(other) == 1 and own not in near and word.isalpha():
                t = other.pop()
                if all(ch in _TABLES[t] for ch in word) and (own != "L" or len(word) < 4):
                    to = t
        if to:
            out += [text[at:start], "".join(_TABLES[to].get(ch, ch) for ch in word)]
            at = start + len(word)
    return "".join([*out, text[at:]])


def _plain_latin(text: str) -> str:
    """Dotless and script forms of Latin letters mapped, but in Turkish and phonetic words."""
    turkish = _TURKISH.search(text)

    def word(m) -> str:
        x = m.group()
        if _PHONETIC.search(x) or {"C", "G"} & _alphabets(x).keys():
            return x
        return "".join(ch if ch == "ı" and turkish else LATIN_ODD.get(ch, ch) for ch in x)

    return _ODD_WORD.sub(word, text)


def _plain_punctuation(text: str) -> str:
    """Full-width punctuation mapped in lines without Chinese, Japanese or Korean letters."""
    return "\n".join(x if _CJK_LETTER.search(x) else _FULL_WIDTH.sub(lambda m: unicodedata.normalize("NFKC", m.group()), x) for x in text.split("\n"))


def mapped(text: str) -> str:
    """The consistent form of one value."""
    x = _INVISIBLE.sub("", text)
    x = _JOINER.sub("", x)
    x = _ODD_SPACE.sub(" ", x)
    if "\u3000" in x:
        x = _IDEOGRAPHIC_SPACE.sub(lambda m: m.group() if _CJK.match(x[m.start() - 1 : m.start()] or "a") or _CJK.match(x[m.end() : m.end() + 1] or "a") else " ", x)
    x = _COMPAT.sub(lambda m: unicodedata.normalize("NFKC", m.group()), x)
    x = unicodedata.normalize("NFC", x)
    x = _SARA_AM.sub("\\1\u0e33", x)
    if _FULL_WIDTH.search(x):
        x = _plain_punctuation(x)
    x = _plain_latin(x)
    if ("Ð" in x or "ð" in x or "Ɖ" in x) and "þ" not in x:
        x = re.sub("[ÐðƉ]", lambda m: VIETNAMESE_ETH[m.group()], x)
    return look_alikes(x)


@F.pandas_udf(StringType())
def _mapped(values):
    return values.map(mapped, na_action="ignore")


def field_values(stories: DataFrame, tales: DataFrame) -> DataFrame:
    """(src, row_id, field_name, position, value) of all non-null field values."""
    s = stories.select(F.lit("stories").alias("src"), F.col("story_row_id").alias("row_id"), F.expr("stack(2, 'title', title, 'text', text) as (field_name, value)"))
    s = s.select("src", "row_id", "field_name", F.lit(1).alias("position"), "value")
    t = tales.select(F.lit("fairy_tales").alias("src"), F.col("record_id").alias("row_id"), F.lit("characters").alias("field_name"), F.posexplode("characters").alias("p", "value"))
    return s.unionByName(t.select("src", "row_id", "field_name", (F.col("p") + 1).alias("position"), "value")).filter("value is not null")


def suspect() -> Column:
    v = F.col("value")
    rare = v.rlike(WIDE[:-1] + "\u093c]") & (v.rlike(WIDE_LINE) | v.rlike("[\u0928\u0930\u0933]\u093c"))
    return v.rlike(SUSPECT) | (v.rlike(r"\p{IsCyrillic}") & v.rlike(r"\p{IsLatin}")) | rare


def mapped_suspects(values: DataFrame) -> DataFrame:
    """The suspect values with their mapped form, written once, as they are read twice."""
    return cut(values.filter(suspect()).withColumn("form", _mapped("value")))


def _skeleton(c: str) -> Column:
    """Hash of the ASCII characters but spaces: equal for values that look the same."""
    return F.xxhash64(F.regexp_replace(c, "[^!-~]+", ""))


def classes(seen: DataFrame, values: DataFrame) -> DataFrame:
    """(class, canonical): one member for each class of the mapped forms and the clean
    values beside them, under the collation."""
    forms = seen.filter("form <> value").select("form").distinct()
    keys = small_side(forms.select(_skeleton("form").alias("k")).distinct(), KEYS)
    clean = values.filter(~suspect()).join(keys, _skeleton("value") == F.col("k"), "left_semi").select(F.col("value").alias("form"))
    # a suspect value that is its own form is clean too
    clean = clean.unionByName(seen.filter("form = value").select("form")).distinct()
    members = forms.withColumn("mapped", F.lit(1)).unionByName(clean.withColumn("mapped", F.lit(0)))
    got = members.groupBy(F.collate("form", "UNICODE").alias("class")).agg(F.min(F.struct("mapped", "form")).alias("m"), F.max("mapped").alias("any"))
    return got.filter("any = 1").select("class", F.collate(F.col("m.form"), "UTF8_BINARY").alias("canonical"))


def canonical_suspects(seen: DataFrame, values: DataFrame) -> DataFrame:
    """The suspect values that are not their own form, with the member of their class."""
    changed = seen.filter("form <> value")
    by = classes(seen, values)
    members = changed.select("form").distinct().join(by, F.collate("form", "UNICODE") == F.col("class")).select(F.col("form").alias("member"), "canonical")
    return changed.join(members, changed.form == members.member, "left").select("src", "row_id", "field_name", "position", "value", F.coalesce("canonical", "form").alias("canonical"))


def unified(values: DataFrame) -> DataFrame:
    """Every value in its consistent form: (src, row_id, field_name, position,
    canonical, changed)."""
    seen = mapped_suspects(values)
    ids = ["src", "row_id", "field_name", "position"]
    same = values.filter(~suspect()).unionByName(seen.filter("form = value").drop("form")).select(*ids, F.col("value").alias("canonical"), F.lit(False).alias("changed"))
    return same.unionByName(canonical_suspects(seen, values).select(*ids, "canonical", (F.col("canonical") != F.col("value")).alias("changed")))


def affected(values: DataFrame) -> DataFrame:
    """(src, row_id, field_name) with at least one value that is not canonical."""
    found = canonical_suspects(mapped_suspects(values), values)
    return found.filter("canonical <> value").select("src", "row_id", "field_name").distinct()
