"""Text expressions of the SQL side. They share no table with the operators: letters
lose their accents by DuckDB's own function, character by character, and what it does
not know is written out here. {0} stands for the argument."""


def _chars(*codes: int) -> str:
    return "".join(map(chr, codes))


# Devanagari letters with a nukta in one code point, and their plain letters.
_NUKTA = _chars(0x929, 0x931, 0x934, *range(0x958, 0x960)), _chars(0x928, 0x930, 0x933, 0x915, 0x916, 0x917, 0x91C, 0x921, 0x922, 0x92B, 0x92F)
_SCRIPTS = r"[\\p{{Latin}}\\p{{Cyrillic}}\\p{{Greek}}\\p{{Hiragana}}\\p{{Katakana}}]".replace("\\\\", "\\")
_PLAIN = f"array_to_string(list_transform(string_split(translate(%s, '{_NUKTA[0]}', '{_NUKTA[1]}'), ''), lambda c: case when regexp_matches(c, '{_SCRIPTS}') then strip_accents(c) else c end), '')"
_LOWER = "replace(lower({0}), 'ß', 'ss')"
FOLD = "regexp_replace(" + _PLAIN % f"replace({_LOWER}, 'đ', 'd')" + r", '\p{{Mn}}', '', 'g')"
LOWER = _LOWER
# Marks that combine, of the scripts of these tables.
_MARKS = r"[\x{{0300}}-\x{{036f}}\x{{093c}}\x{{094d}}\x{{0951}}-\x{{0954}}\x{{0e38}}-\x{{0e3a}}\x{{0e48}}-\x{{0e4b}}\x{{3099}}\x{{309a}}]"
_WIDE = "array_to_string(list_transform(string_split(replace({0}, chr(3635), chr(3661) || chr(3634)), ''), lambda c: case when unicode(c) between 65281 and 65374 then chr(cast(unicode(c) - 65248 as int)) else c end), '')"
STRIP = "regexp_replace(" + _PLAIN % ("translate(" + _WIDE + ", 'đĐ', 'dD')") + f", '{_MARKS}', '', 'g')"
KEY = f"trim(regexp_replace(lower(trim({STRIP})), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+', ' ', 'g'))"
NORMAL = "trim(regexp_replace(replace(lower(nfc_normalize({0})), 'ß', 'ss'), '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\p{{Z}}]+', ' ', 'g'))"
