"""Problem 10: personal information inside free text.

A semi-Markov conditional random field. Segments of bounded length are taken from at
signs, digit groups, number words, street words with a number, every run of up to four
capitalised words, short runs of Han or kana between punctuation and words after Hindi
forms of address; every segment is scored as a whole by features of its shape, its
inside, its borders, the phrases and roles beside it and the other items of its
sentence, and a dynamic program over non-overlapping segments with transitions between
neighbouring types chooses boundaries and types jointly. The weights maximise the
likelihood of the right segmentations of sentences composed from the fixed patterns
below with invented fillers: a forward and a backward pass give the expected features,
the steps are AdaGrad's, with a quadratic penalty.

Most runs of capitals in a tale have no role word and no other item in reach. All they
can have is known, so `bound` proves from the weights that none of them can be chosen,
and they are not built; if it cannot, every run is scored.

The phrases of BEFORE_NAME, AFTER_NAME, LABELS and NOT_PERSONAL were drawn up with the
documents in view; the training patterns are other wordings than theirs but for labels
and single words. Names of one word, in lower case or in Thai are proposed only beside
such a phrase. The tests train on a part of the patterns and measure the rest.

Defined results: null texts give no items and stay null, empty ones empty; items
are numbered by position; the same item twice is two rows; repeated rows are
treated each for itself; overlapping candidates leave the best scored choice, ties
the leftmost, longest one.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

TYPES = ("email", "phone", "identity", "address", "name")
PLACEHOLDERS = {t: f"[{t.upper()}]" for t in TYPES}

# Phrases that introduce a person, by language; forms of address may follow.
BEFORE_NAME = {
    "en": "sent in by|told by|recorded from|narrated by|written down by|collected by|belonged to|belongs to|owned by|ask for|asking for|post the pamphlet to|my name is|i am called|contact|signed,|care of",
    "vi": "theo lời|tôi tên(?: là)?|người kể:|nhắn cho|hỏi|của chị|của anh|của ông|của bà|của cô|của em|người sưu tầm|do chính|liên hệ với|ghi theo lời",
    "fr": "conté par|je m'appelle|recueilli auprès de|envoi de|envoyé par|raconté par|appartenant à|demander",
    "de": "erzählt von|ich heiße|aufgenommen bei|eingesandt von|aufgeschrieben von|gehört|fragen sie nach",
    "es": "contado por|me llamo|recogido de|enviado por|narrado por|pertenece a|pregunte por",
    "ru": "прислано:|рассказала|рассказал|записано от|меня зовут|принадлежит|спросить",
    "zh": "讲述人|讲述者：|记录人|联系人|我叫",
    "ja": "語り手は|記録者は|連絡先は|私は",
    "th": "เล่าโดย|บันทึกโดย|ผู้เล่าคือ|ดิฉันชื่อ|ผมชื่อ",
    "hi": "सुनाया|कथावाचक:|मेरा नाम",
}
# Phrases that follow a person.
AFTER_NAME = {
    "en": "typed this|wrote this down|sent this in|copied this|owns this",
    "vi": "chép lại|gửi tặng|ghi lại chuyện|kể lại chuyện",
    "zh": "，证件号|，电话|，身份证",
    "ja": "さん、電話|さんの語り",
}
HONORIFICS = "mrs|mr|ms|miss|dr|mme|m|mlle|frau|herr|doña|don|sra|sr|bà|ông|cô|chị|anh|em|chú|bác|thầy|cháu|г-жа|г-н|นาง|นาย"
# Labels before the other types.
LABELS = {
    "phone": "tel|tel.|phone|call|ring|reach us on|next to|gọi|điện thoại|theo số|liên hệ|số|appeler le|joignable au|téléphone|unter|telefon|llame al|mi número es|teléfono|тел.|телефон|电话|電話|โทร|หรือ|फ़ोन|संपर्क",
    "identity": "id|passport|the number|ssn|cccd số|cccd|cmnd|căn cước|hộ chiếu|n°|numéro|ausweis|pass|dni|nie|паспорт|снилс|证件号|身份证|身份証|บัตร",
    "address": "lives at|grew up at|lived at|address|nhà ở|trước ở|để tại|ở|địa chỉ|qui habite|demeurant|adresse|wohnhaft|wohnt|vive en|vivo en|domicilio|проживает|адрес",
}
# What a number is that is no personal one.
NOT_PERSONAL = "isbn|shelf mark|lines|version|copy no.|no.|vol.|p.|pp.|kệ|đoạn|khổ|giá|bản số|cote|impression|signatur|erdruck|signatura|шифр|书号|請求記号|รหัส|क्रम|tickets"

_SPACE = r"[ \t]*\r?\n?[ \t]*"
_AT = rf"(?:{_SPACE}(?:@|＠|\[at\]|\(at\)){_SPACE})"
_DOT = rf"(?:\.|{_SPACE}\[dot\]{_SPACE}|{_SPACE}\(dot\){_SPACE})"
EMAIL = re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+\-]*{_AT}[A-Za-z0-9\-]+(?:{_DOT}[A-Za-z0-9\-]+)*{_DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9])", re.I)
_DIGIT = "[0-9０-９]"
#: Groups of digits with what may stand between them in one number.
NUMBER = re.compile(rf"(?:(?<![A-Za-z])(?!ID\s|No)[A-Z]{{1,2}}\s?)?(?:\(\+?{_DIGIT}{{1,4}}\)|\+{_DIGIT}{{1,3}}|{_DIGIT}+)(?:(?:[ \-.–]|\s?/\s?|\r?\n|\s?\({_DIGIT}{{1,4}}\)\s?|\([0０]\))?{_DIGIT}+)*(?:[\-\s]?[A-ZÑ](?![A-Za-zÀ-ỹ]))?")
NUMBER_WORDS = {
    "vi": "không một hai ba bốn năm sáu bảy tám chín",
    "en": "zero one two three four five six seven eight nine",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
SPELT = re.compile("|".join(rf"(?<!\w)(?:{'|'.join(w.split())})(?:\s+(?:{'|'.join(w.split())})){{6,14}}(?!\w)" for w in NUMBER_WORDS.values()), re.I)
_CAP = r"[^\W\d_][\w'’\-]*"
_CAPS = rf"{_CAP}(?:\s+{_CAP}){{0,3}}"
_UP = r"[A-ZÀ-ÖØ-ÞĐ][\w'’\-]*"
# Words for streets and for the parts of a town.
STREETS_VI, PARTS_VI = "phố|đường|ngõ|ngách|hẻm|thôn", "phường|xã|quận|huyện|thị trấn|thành phố|P\\.|Q\\.|TP\\."
STREETS_EN = "Street|St\\.?|Road|Rd\\.?|Lane|Ln\\.?|Row|Close|Avenue|Ave\\.?|Way|Court|Drive|Place|Square|Terrace|Hill|Gate"
STREETS_FR = "rue|allée|avenue|boulevard|chemin|impasse|place|quai|route"
STREETS_ES = "calle|plaza|camino|avenida|paseo|callejón|carretera"
STREETS_RU, STREETS_ZH, PARTS_JA = "ул\\.|улица|пер\\.|переулок|пр-т|проспект|наб\\.", "路|街|巷|弄|大道|胡同", "市|区|郡"
ADDRESS = {
    "vi": re.compile(rf"{_DIGIT}+[A-Za-z]?(?:/{_DIGIT}+[A-Za-z]?)?\s+(?:{STREETS_VI})\s+{_CAP}(?:\s+{_CAP}){{0,2}}(?:,\s+(?:{PARTS_VI})\s+{_CAP}(?:\s+{_CAP})?)*"),
    "en": re.compile(rf"{_DIGIT}+[A-Za-z]?\s+{_CAP}(?:\s+{_CAP})?\s+(?:{STREETS_EN})(?!\w)(?:,\s+{_CAP}(?:\s+{_UP})?)?", re.I),
    "fr": re.compile(rf"{_DIGIT}+(?:\s+(?:bis|ter))?,?\s+(?:{STREETS_FR})\s+{_CAPS}(?:,\s+{_CAP})?", re.I),
    "de": re.compile(rf"(?:{_CAP}(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|ring|damm)|(?:Am|Im|An der|Auf dem|Zum|Zur)\s+{_CAP}|{_CAP}\s+(?:Straße|Weg|Gasse|Platz|Allee|Ring))\s+{_DIGIT}+[a-z]?(?!\w)(?:,\s+{_CAP})?", re.I),
    "es": re.compile(rf"(?:{STREETS_ES})\s+(?:(?:del|de|la|las|los|el)\s+){{0,2}}{_CAP}(?:\s+{_CAP})?\s+{_DIGIT}+(?:,\s+{_DIGIT}+\.?[ºª]\s+[A-Z])?(?:,\s+{_UP}(?:\s+(?:de\s+)?{_UP}){{0,2}})?", re.I),
    "ru": re.compile(rf"(?:(?:г\.|город)\s+{_CAP},\s+)?(?:{STREETS_RU})\s+{_CAP}(?:\s+{_CAP})?,\s+(?:д\.|дом)?\s*{_DIGIT}+[а-я]?(?:,\s+(?:кв\.|квартира)\s*{_DIGIT}+)?", re.I),
    "zh": re.compile(rf"(?:(?<=[在址于：:，,。 \n])|^)(?![住在])(?:[一-鿿]{{2,8}}[省市区县镇乡村]){{0,3}}[一-鿿]{{1,6}}(?:{STREETS_ZH}){_DIGIT}+[号號](?:{_DIGIT}+(?:室|楼|单元)){{0,2}}"),
    "ja": re.compile(rf"(?:(?<=[はに所：:、。 \n])|^)(?:[一-鿿]{{2,3}}[都道府県])?[一-鿿]{{1,5}}[市区郡](?:[一-鿿ぁ-んァ-ヿ]{{1,5}}[町村])?[一-鿿ぁ-んァ-ヿ]{{0,6}}{_DIGIT}+(?:(?:丁目|番地?|[-−‐－]){_DIGIT}+){{0,3}}号?"),
}
_alt = lambda x: "|".join(sorted((re.escape(p).replace(r"\ ", r"\s+") for p in x), key=len, reverse=True))
_HONOR = rf"(?:(?:{HONORIFICS})\.?\s+)?"
# Cues are found by one automaton over the lower-cased text; at a cue the patterns
# run on the few characters around it.
_ADDRESSED = re.compile(rf"\s*{_HONOR}{_HONOR}", re.I)
# Words that open a window for ADDRESS, those of its patterns.
STREET_CUES = {
    "vi": STREETS_VI, "en": STREETS_EN, "fr": STREETS_FR, "es": STREETS_ES,
    "ru": STREETS_RU, "zh": STREETS_ZH, "ja": PARTS_JA,
    "de": "straße|strasse|str.|gasse|weg|platz|allee|ufer|ring|damm|am|im|an der|auf dem|zum|zur",
}
# Beginnings of words for telling, sending, writing down, owning and being reached.
ROLES = tuple("told tell given pass owe lent lend narrat recount record collect contribut submit donat sent send sender shar wrote writ typ copi transcrib sign own belong propert contact reach call ring ask informant courtesy thank name kể gửi chép nhờ ghi sưu tên liên nhắn thuộc cảm cont racont narr recueil envo écri transcri appart propri contact demand appel merci remerc donné nomm mitgeteil erzähl einsend eingesand aufgezeich aufgeschrieb aufgenomm geschick gehör besitz frag heiß dank nam contad relat recog envi escrit transcri pertene propie pregunt llam graci agrad dad рассказ записа присла сообщ принадлеж владел зовут спрос пис благодар передал सुना कथा भेज नाम लिख संपर्क เล่า บันทึก ส่ง ชื่อ ติดต่อ เจ้าของ".split())
HAN_ROLES = re.compile("[讲講述记記录録寄供语語話连連联聯投藏]|我叫|姓名|名前")


@lru_cache(maxsize=1)
def _cues():
    import ahocorasick

    found: dict[str, set[str]] = defaultdict(set)
    for language, v in STREET_CUES.items():
        for p in v.split("|"):
            for x in {p.replace("\\.?", ""), p.replace("\\.?", ".").replace("\\.", ".")}:
                found[x.lower()].add(f"street:{language}")
    for kind, phrases in (("intro", BEFORE_NAME.values()), ("after", AFTER_NAME.values())):
        for v in phrases:
            for p in v.split("|"):
                for x in ([p.replace("(?: là)?", ""), p.replace("(?: là)?", " là")] if "(?" in p else [p]):
                    found[x.lower()].add(kind)
    for p in ROLES:
        found[p].add("role")
    for words in NUMBER_WORDS.values():
        for a in words.split():
            for b in words.split():
                for c in words.split():
                    found[f"{a} {b} {c}"].add("spelt")
    machine = ahocorasick.Automaton()
    for phrase, kinds in found.items():
        machine.add_word(phrase, (len(phrase), tuple(kinds)))
    machine.make_automaton()
    return machine


_DENSE = re.compile(r"\d[\d .\-–/()\n]{5,}\d|\d{6,}")
# Vowel signs of Thai and Devanagari are no word characters.
_L = r"(?:[^\W\d_]|[\u0900-\u0903\u093a-\u094f\u0e31\u0e34-\u0e3a\u0e47-\u0e4e])"
_NAME_TOKEN = re.compile(rf"[^\W\d_]{_L}*(?:['’\-]{_L}+)*")
_PARTICLE = r"(?:de|del|della|da|di|du|la|le|van|von|bin|al)"
_INITIAL = r"[A-ZÀ-ÖØ-Þ]\."
_CAPITAL = rf"(?:[A-ZÀ-ÖØ-ÞĐĂƠƯŁŚŠŽČĀĨŨẠ-ỹЀ-Я](?<![ạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]){_L}*(?:['’\-]{_L}+)*)"
#: Runs of capitalised words, with initials and particles inside.
CAPITAL_RUN = re.compile(rf"(?<![\w@.'’\-]){_CAPITAL}(?:[ \t]*\r?\n?[ \t]*(?<=\s)(?:{_PARTICLE}\s+){{0,2}}(?:{_CAPITAL}|{_INITIAL}))+")
HAN_RUN = re.compile(r"(?:(?<=[：:，、（(；。！？\s])|(?<=[人者名是叫は]))[一-鿿]{2,4}(?=[，（(；）)。]|$)|(?<=[はの者手：:、，。（(「\s])[一-鿿ァ-ヿ][一-鿿ァ-ヿぁ-のひ-ん]{0,5}(?: [一-鿿ァ-ヿぁ-ん]{1,6}?)?(?=さん|氏|様)")
ADDRESSED_RUN = re.compile(r"(?:श्रीमती|श्री|कुमारी)\s+")
_IN_CAPITALS = re.compile(r"(?<!\w)[^\W\d_a-zà-ỹ]{2}")
_HAN_NAME = re.compile(r"[一-鿿぀-ヿ]{1,6}(?: [一-鿿぀-ヿ]{1,6})?")
_AFTER_WORDS = frozenset(p.split()[0] for v in AFTER_NAME.values() for p in v.split('|'))
# Words that follow a name in running text and are never part of one.
STOP_WORDS = frozenset("and or who which was is und y et que qui i he she it for the this that và theo còn là gửi chép trước nhà ở số ai và bin unter wohnhaft mi me und from of to in on at by với của trên dưới trong bên cho đã".split())

def _digits(x: str) -> str:
    return "".join(ch for ch in x if ch.isdigit())


def _shape(word: str) -> str:
    return "A" if len(word) > 1 and word.isupper() else "C" if word[:1].isupper() else "a" if word[:1].islower() else "o"


class Span:
    __slots__ = ("features", "kind", "start", "end", "score")

    def __init__(self, kind: str, start: int, end: int, features: list[str]):
        self.kind, self.start, self.end, self.features, self.score = kind, start, end, features, 0.0


_LABEL_RE = {k: re.compile(rf"(?:{_alt(v.split('|'))})[:.]?\s*[<(]?$", re.I) for k, v in LABELS.items()}
_NOT_RE = re.compile(rf"(?:{_alt(NOT_PERSONAL.split('|'))})[:.]?\s*$", re.I)


def _context(text: str, start: int, end: int) -> list[str]:
    before = text[max(0, start - 28) : start]
    out = [f"label:{k}" for k, r in _LABEL_RE.items() if r.search(before)]
    if _NOT_RE.search(before):
        out.append("label:none")
    return out or ["label:no"]


def _number_features(x: str) -> list[str]:
    d = _digits(x)
    letters = [ch for ch in x if ch.isalpha()]
    groups = re.findall(rf"{_DIGIT}+", x)
    out = [f"n:{len(d)}", f"groups:{min(len(groups), 6)}", f"lead:{d[:1] == '0'}", "plus" if "+" in x else "noplus", "paren" if x[:1] == "(" else "noparen"]
    out.append(f"letters:{len(letters)}{'first' if letters and x[0].isalpha() else ''}{'last' if letters and x[-1].isalpha() else ''}")
    out.append(f"shape:{re.sub(_DIGIT, '9', x)}" if len(d) < 13 else "shape:long")
    if "/" in x:
        out.append("slash")
    return out


def _lower(text: str) -> str:
    """Lower case of the same length, line breaks as spaces."""
    x = text.lower()
    if len(x) != len(text):
        x = "".join(y if len(y := ch.lower()) == 1 else ch for ch in text)
    return x.replace("\n", " ")


def _letter(ch: str) -> bool:
    return ch.isalnum() and ch < "\u0e00"


_A_DIGIT = re.compile(_DIGIT)


def _address_features(x: str) -> list[str]:
    words = [w for w in _NAME_TOKEN.findall(x) if len(w) > 1]
    capitals = sum(w[0].isupper() for w in words)
    return [f"capitals:{'all' if capitals == len(words) else 'none' if not capitals else 'one' if capitals == 1 else 'more'}"]


def candidates(text: str, everywhere: tuple[bool, bool] = (False, False)) -> list[Span]:
    """Segments of every type, in order of their start; names out of reach of any role
    or item only with everywhere."""
    out: list[Span] = []
    low = _lower(text)
    if "@" in text or "＠" in text or "at]" in low or "at)" in low:
        for at in re.finditer(r"@|＠|\[at\]|\(at\)", low):
            s = max(0, at.start() - 70)
            m = next((m for m in EMAIL.finditer(text, s, min(len(text), at.end() + 90)) if m.start() <= at.start() < m.end()), None)
            if m:
                out.append(Span("email", m.start(), m.end(), ["bias", "at:" + re.sub(r"\s", " ", re.sub("[A-Za-z0-9._%+-]", "", m.group()))[:8]]))
    reach = 0
    for dense in _DENSE.finditer(text):
        for m in NUMBER.finditer(text, max(reach, dense.start() - 4), min(len(text), dense.end() + 3)):
            s, e = m.span()
            x = m.group()
            n = sum(ch.isdigit() for ch in x)
            if n < (6 if x[0].isalpha() and x[-1].isalpha() else 7) or n > 20:
                continue
            reach = e
            f = ["bias", *_context(text, s, e), *_number_features(x)]
            out += [Span(kind, s, e, f) for kind in ("phone", "identity")]
    spelt = 0
    seen: set[tuple[int, int]] = set()
    roles: list[int] = []
    for last, (n, kinds) in _cues().iter(low):
        s, e = last + 1 - n, last + 1
        if "role" in kinds and not (s and _letter(low[s - 1])):
            roles.append(s)
        if (s and _letter(low[s - 1]) and _letter(low[s])) and not any(k[:7] == "street:" for k in kinds) or e < len(low) and _letter(low[e]) and _letter(low[last]):
            continue
        for kind in kinds:
            if kind[:7] != "street:" and s and _letter(low[s - 1]) and _letter(low[s]):
                continue
            if kind == "intro":
                m = _ADDRESSED.match(text, e)
                _names_from(text, m.end(), "intro:" + low[s:e].split()[0][:12], out)
            elif kind == "after":
                _names_to(text, s, "after:" + low[s:e][:6], out)
            elif kind == "spelt" and s >= spelt:
                m = SPELT.search(text, s, min(len(text), s + 120))
                if m:
                    spelt = m.end()
                    out.append(Span("phone", m.start(), m.end(), ["bias", "spelt", *_context(text, m.start(), m.end())]))
            elif kind[:7] == "street:":
                language = kind[7:]
                a, b = max(0, s - 48), min(len(text), e + 80)
                if language not in ("zh", "ja") and (language != "de" or low[s:e] in ("am", "im", "zum", "zur")) and s and _letter(low[s - 1]) or not _A_DIGIT.search(text, a, b):
                    continue
                for m in ADDRESS[language].finditer(text, a, b):
                    if m.span() not in seen and m.start() <= e + 1 and not (m.start() and _letter(text[m.start() - 1])):
                        seen.add(m.span())
                        out.append(Span("address", m.start(), m.end(), ["bias", f"form:{language}", f"commas:{min(2, m.group().count(','))}", *_address_features(m.group()), *_context(text, m.start(), m.end())]))
    _names_by_shape(text, roles, out, everywhere)
    out = _with_context(text, out, everywhere)
    out.sort(key=lambda s: (s.start, -s.end))
    return out


def _border(text: str, end: int) -> str:
    rest = text[end : end + 14]
    if re.match(r"\s*[,;:()\[\]（），、；—]|さん", rest):
        return "comma"
    if not rest or re.match(r"\s*[.。!?\n]", rest):
        return "end"
    w = _NAME_TOKEN.match(rest.lstrip())
    if not w:
        return "other"
    return "stop" if w.group().lower() in STOP_WORDS or w.group().lower() in _AFTER_WORDS else "capital" if w.group()[0].isupper() else "word"


def _name_span(text: str, start: int, end: int, words: list[str], cue: str) -> Span:
    shapes = "".join(_shape(w) for w in words)
    same = len(set(shapes)) == 1
    f = ["bias", cue, f"cue:{cue.split(':')[0]}", f"words:{len(words)}", f"border:{_border(text, end)}", f"shape:{shapes}", f"same:{same}", f"words:{len(words)}:border:{_border(text, end)}"]
    if any(w.lower() in STOP_WORDS for w in words):
        f.append("stopword")
    return Span("name", start, end, f)


def _names_by_shape(text: str, roles: list[int], out: list[Span], everywhere: tuple[bool, bool]) -> None:
    """Runs with a role or another item in reach, or all."""
    others = sorted((s.start, s.end) for s in out if s.kind != "name" and "label:none" not in s.features)
    reached: list[tuple[int, int]] = []
    for s, e in sorted([(s - BESIDE, e + BESIDE) for s, e in others] + [(s - ROLE_REACH, s + ROLE_REACH) for s in sorted(roles)] + [(m.start() - 8, m.end() + 8) for m in HAN_ROLES.finditer(text)]):
        if reached and s <= reached[-1][1]:
            reached[-1] = (reached[-1][0], max(e, reached[-1][1]))
        else:
            reached.append((s, e))
    opened = [s for s, _ in reached]

    def held(m) -> bool:
        if everywhere[bool(_IN_CAPITALS.search(m.group()))]:
            return True
        k = bisect_right(opened, m.end()) - 1
        return k >= 0 and reached[k][1] >= m.start()

    for run in CAPITAL_RUN.finditer(text):
        if not held(run):
            continue
        tokens = list(re.compile(rf"{_INITIAL}(?=\s)|{_NAME_TOKEN.pattern}").finditer(text, run.start(), run.end()))
        for i in range(len(tokens)):
            if tokens[i].group()[0].islower():
                continue
            for j in range(i + 1, min(i + 6, len(tokens))):
                words = [t.group() for t in tokens[i : j + 1]]
                full = sum(not w[0].islower() for w in words)
                if full > 4:
                    break
                if words[-1][0].islower() or words[0].lower() in _HONORIFIC_WORDS:  # forms of address are no part of an item
                    continue
                inside = [w for w in words if not w[0].islower()]
                span = _name_span(text, tokens[i].start(), tokens[j].end(), inside, "run")
                if words[0].lower().startswith(ROLES) or words[0].lower() in STOP_WORDS:
                    span.features.append("led")
                if i:
                    last = tokens[i - 1].group().lower()
                    span.features.append("tail:titled" if last in _HONORIFIC_WORDS else "tail:role" if last.startswith(ROLES) else "tail")
                if j + 1 < len(tokens):
                    span.features.append("cutoff")
                out.append(span)
    for m in HAN_RUN.finditer(text):
        if m.end() - m.start() > 1 and held(m):
            border = _border(text, m.end())
            out.append(Span("name", m.start(), m.end(), ["bias", "han", "run", f"han:{len(m.group())}", f"border:{border}", f"han:border:{border}"]))
    for m in ADDRESSED_RUN.finditer(text):
        if held(m):
            _names_from(text, m.end(), "intro:honorific", out)


_SENTENCE_END = re.compile(r"[.!?…](?<!\b[A-ZÀ-Þ]\.)(?<!Tel\.)(?<!tel\.)(?<!тел\.)(?<!Mrs\.)(?<!Mr\.)(?<!Dr\.)(?<!St\.)(?<!Rd\.)(?<!TP\.)[\"”’»)]*\s+(?=[\"“«¿¡(—–]?\s?[^\W\d_])|[。！？।]|\n\s*\n")
#: Items within so many characters count as beside a name; roles are sought in fewer.
BESIDE, ROLE_REACH = 90, 36


def _with_context(text: str, spans: list[Span], everywhere: tuple[bool, bool]) -> list[Span]:
    """Names proposed twice become one; each gets the items and roles of its sentence."""
    others = sorted((s for s in spans if s.kind != "name" and "label:none" not in s.features), key=lambda s: s.start)
    starts = [s.start for s in others]
    merged: dict[tuple[int, int], Span] = {}
    for s in spans:
        if s.kind == "name":
            if (s.start, s.end) in merged:
                own = merged[s.start, s.end].features
                own += [f for f in s.features if f not in own]
            else:
                merged[s.start, s.end] = s
    kept = [s for s in spans if s.kind != "name"]
    for s in merged.values():
        found, reached = set(), False
        for k in range(bisect_right(starts, s.start - BESIDE - 160), bisect_right(starts, s.end + BESIDE)):
            o = others[k]
            kind = "number" if o.kind in ("phone", "identity") else o.kind
            if o.start < s.end and s.start < o.end:
                found.add(f"in:{kind}")
                continue
            side, between = ("right", text[s.end : o.start + 1]) if o.start >= s.end else ("left", text[o.end : s.start + 1])
            reached = reached or len(between) <= NEAR + 1
            if len(between) <= BESIDE and not _SENTENCE_END.search(between):
                found.update((f"beside:{kind}", f"beside:{side}", "beside"))
        if "in:email" in found:
            continue
        before, after = text[max(0, s.start - ROLE_REACH) : s.start + 1], text[s.end : s.end + ROLE_REACH]
        before = before[max((m.end() for m in _SENTENCE_END.finditer(before)), default=0) : -1]
        end = _SENTENCE_END.search(after)
        after = after[: end.start()] if end else after
        left, right = (_NAME_TOKEN.findall(x.lower()) for x in (before, after))
        if "han" in s.features:
            roles = [bool(HAN_ROLES.search(before[-8:])), bool(HAN_ROLES.search(after[:8]))]
        else:
            roles = [any(w.startswith(ROLES) for w in left[-5:]), any(w.startswith(ROLES) for w in right[:3])]
            if left:
                found.add("honorific" if left[-1] in _HONORIFIC_WORDS else "by" if left[-1] in _BY else "plain")
        found.update(f"role:{x}" for x, there in zip(("before", "after"), roles) if there)
        if "han" not in s.features:
            found.update(f"role:{x}:{k}" for x, ws in (("before", left[::-1][:3]), ("after", right[:2])) for k, w in enumerate(ws) if w.startswith(ROLES))
        near = "beside" in found
        found.add(f"evidence:{near}:{any(roles)}")
        if "run" in s.features or "cue:run" in s.features and "cue:intro" not in s.features and "cue:after" not in s.features:
            if "in:address" in found or not everywhere[any("A" in f for f in s.features if f[:6] == "shape:")] and not near and not any(roles) and not reached:
                continue
            found.add(f"nocue:{near}:{any(roles)}")
            if roles[0] and ("by" in found):
                found.add("nocue:role by")
        s.features += sorted(found)
        kept.append(s)
    return kept


def _names_from(text: str, at: int, cue: str, out: list[Span]) -> None:
    m = _HAN_NAME.match(text, at)
    if m:
        x = m.group().split("さん")[0]
        for k in sorted({len(x), 2, 3, 4}):
            if 2 <= k <= len(x) and not x[:k].endswith(" "):
                out.append(Span("name", at, at + k, ["bias", "han", f"han:{k}", f"border:{_border(text, at + k)}", f"han:border:{_border(text, at + k)}"]))
        return
    words, end = [], at
    while len(words) < 4:
        m = _NAME_TOKEN.match(text, end)
        if not m:
            break
        words.append(m.group())
        out.append(_name_span(text, at, m.end(), list(words), cue))
        gap = re.compile(r"[ \t]*\r?\n?[ \t]*").match(text, m.end())
        if gap.end() == m.end():
            break
        end = gap.end()


def _names_to(text: str, end: int, cue: str, out: list[Span]) -> None:
    end = len(text[:end].rstrip()) if end and text[end - 1].isspace() else end
    before = text[max(0, end - 60) : end]
    if _HAN_NAME.search(before[-1:]):
        m = re.search(r"[一-鿿぀-ヿ]+(?: [一-鿿぀-ヿ]+)?$", before)
        x = m.group()
        for k in sorted({len(x), 2, 3, 4}):
            if 2 <= k <= min(8, len(x)):
                s = end - k
                opened = s == 0 or text[s - 1] in "。！？\n；，」』人"
                out.append(Span("name", s, end, ["bias", "han", f"han:{k}", f"opened:{opened}", "border:comma", "han:border:comma"]))
        return
    words: list[str] = []
    for m in reversed(list(_NAME_TOKEN.finditer(before))[-4:]):
        if words and text[end - len(before) + m.end() : first].strip():
            break
        if not words and before[m.end() :].strip():
            break
        words.insert(0, m.group())
        first = end - len(before) + m.start()
        span = _name_span(text, first, end, list(words), cue)
        left = text[max(0, first - 2) : first]
        span.features.append("opened" if not left.strip() and "\n" in left or first == 0 or re.search(r"[.!?(;—:]\s?$", left) or text[max(0, first - 6) : first].strip().lower() in ("cháu", "ông", "bà", "chị", "cô") else "notopened")
        out.append(span)


_HONORIFIC_WORDS = frozenset(HONORIFICS.split("|"))
# Words between a role and its person.
_BY = frozenset("by to from of par de à auprès chez von bei vom an por a del от у к là bởi của cho chị".split())
#: Segments of which a transition is scored begin within so many characters.
NEAR = 40


class Model:
    """Weights of features and of transitions between types."""

    def __init__(self):
        self.w: dict[tuple[str, str], float] = defaultdict(float)
        self._lift: dict[str, float] = {}
        #: Whether names out of reach are scored, without and with words in capitals.
        self.everywhere = (False, False)

    def scored(self, spans: list[Span]) -> None:
        for s in spans:
            s.score = sum(self.w.get((s.kind, f), 0.0) for f in s.features)

    def best(self, spans: list[Span]) -> list[Span]:
        """The non-overlapping segments of the highest total score; one before the
        next may add a transition weight. Positions of the program are the ends."""
        w = self.w
        self.scored(spans)
        # states: best total of a choice whose last segment is order[i]; only the last
        # NEAR characters can add a transition, before them the best total counts. A segment
        # needs a positive score or a transition that can lift it.
        order = sorted((s for s in spans if s.score > -self.lift(s.kind)), key=lambda s: (s.end, s.start))
        ends = [s.end for s in order]
        totals: list[tuple[float, int]] = []
        upto: list[tuple[float, int]] = []  # the best total so far and its segment
        for i, s in enumerate(order):
            far = bisect_right(ends, s.start - NEAR, 0, i)
            top, back = max((0.0, -1), upto[far - 1], key=lambda x: x[0]) if far else (0.0, -1)
            for j in range(bisect_right(ends, s.start, far, i) - 1, far - 1, -1):
                gain = totals[j][0] + w.get(("then", order[j].kind + ">" + s.kind), 0.0)
                if gain > top:
                    top, back = gain, j
            totals.append((top + s.score, back))
            upto.append(max((totals[-1][0], i), upto[-1], key=lambda x: x[0]) if upto else (totals[-1][0], i))
        if not totals:
            return []
        i = max(range(len(totals)), key=lambda k: (totals[k][0], -order[k].start, order[k].end))
        if totals[i][0] <= 0:
            return []
        out = []
        while i >= 0:
            out.append(order[i])
            i = totals[i][1]
        return out[::-1]

    def lift(self, kind: str) -> float:
        """The most that transitions before and after can add to a segment."""
        if kind not in self._lift:
            pairs = [(f.split(">"), v) for (k, f), v in self.w.items() if k == "then"]
            self._lift[kind] = sum(max([0.0, *(v for ends, v in pairs if ends[side] == kind)]) for side in (0, 1))
        return self._lift[kind]

    def gradient(self, spans: list[Span], gold: list[Span]) -> tuple[dict[tuple[str, str], float], float]:
        """(derivative of the log likelihood of a segmentation, the log likelihood):
        features of the right segments less the expected ones, by a forward and a
        backward pass over the segments in the order of their ends."""
        self.scored(spans)
        order = sorted(spans, key=lambda s: (s.end, s.start))
        n = len(order)
        phi = [math.exp(max(-30.0, min(30.0, s.score))) for s in order]
        then = [[(j, math.exp(self.w.get(("then", order[j].kind + ">" + s.kind), 0.0)) if s.start - order[j].end < NEAR else 1.0) for j in range(i) if order[j].end <= s.start] for i, s in enumerate(order)]
        forward, backward = [0.0] * n, [1.0] * n
        for i in range(n):
            forward[i] = phi[i] * (1.0 + sum(forward[j] * t for j, t in then[i]))
        for i in range(n - 1, -1, -1):
            for j, t in then[i]:
                backward[j] += t * phi[i] * backward[i]
        z = 1.0 + sum(forward)
        out: dict[tuple[str, str], float] = defaultdict(float)
        for i, s in enumerate(order):
            p = forward[i] * backward[i] / z
            for f in s.features:
                out[s.kind, f] -= p
            for j, t in then[i]:
                if s.start - order[j].end < NEAR:
                    out["then", order[j].kind + ">" + s.kind] -= forward[j] * t * phi[i] * backward[i] / z
        total = 0.0
        for i, s in enumerate(gold):
            total += s.score
            for f in s.features:
                out[s.kind, f] += 1.0
            if i and s.start - gold[i - 1].end < NEAR:
                key = ("then", gold[i - 1].kind + ">" + s.kind)
                out[key] += 1.0
                total += self.w.get(key, 0.0)
        return out, total - math.log(z)


def bound(model: Model, capitals: bool) -> float:
    """The most that a name out of reach of any role and item can add to a choice: over
    all numbers of words, borders and shapes, with every feature it can have besides; of
    names with a word in capitals alone, or of the others."""
    w = {f: v for (k, f), v in model.w.items() if k == "name"}
    get = lambda *fs: sum(w.get(f, 0.0) for f in fs)
    # a form of address before it, in the run or not, or another word, or none
    extra = sum(max(0.0, get(f)) for f in ("stopword", "led", "cutoff")) + max(0.0, get("honorific"), get("tail:titled", "honorific"), get("by"), get("plain"), get("tail", "by"), get("tail", "plain"))
    best = -99.0
    for words in (2, 3, 4):
        shapes = {f for f in (*w, "shape:" + "AC"[not capitals] * words) if f.startswith("shape:") and len(f) == 6 + words and ("A" in f) == capitals and set(f[6:]) <= {"A", "C"}}
        for border in ("comma", "end", "other", "stop", "capital", "word"):
            for shape in shapes:
                best = max(best, 2 * get("cue:run") + get(f"words:{words}", f"border:{border}", f"words:{words}:border:{border}", shape, f"same:{len(set(shape[6:])) == 1}") + extra)
    for k in () if capitals else range(2, 9):
        for border in ("comma", "end", "other", "stop", "capital", "word"):
            best = max(best, get("run", "han", f"han:{k}", f"border:{border}", f"han:border:{border}"))
    return get("bias", "evidence:False:False", "nocue:False:False") + best + 2 * max(0.0, model.w.get(("then", "name>name"), 0.0))


def items(model: Model, text: str) -> list[Span]:
    """The personal items of a text, in order."""
    if "\r" in text:
        # decided on the text without carriage returns, placed in the text itself
        kept = [i for i, ch in enumerate(text) if ch != "\r"]
        got = items(model, text.replace("\r", ""))
        for s in got:
            s.start, s.end = kept[s.start], kept[s.end - 1] + 1
        return got
    out: list[Span] = []
    # groups of candidates with 40 characters or less between them are decided together
    group: list[Span] = []
    reach = -1
    for s in candidates(text, model.everywhere):
        if group and s.start > reach + NEAR:
            out += model.best(group)
            group = []
        group.append(s)
        reach = max(reach, s.end)
    return out + (model.best(group) if group else [])


# ---------------------------------------------------------------- training

# Patterns of training sentences, none of them a wording of the
# documents. N name in any case, M name not in lower case, E email, P phone,
# I identity, A address; the fillers are invented below.
PATTERNS = {
    "en": "At dawn Mr Orlando Wexley, the miller, laughed.|Nobody saw Mrs Petronella Ashgrove.|The bell was cast by Orlando Wexley and carried off.|A rope came from Petronella Ashgrove and the guild.|They walked to Anselm Birkenfeld and back, by the mill.|The bread went to Jean-Luc Morteau Vane and his sons.|All of it was eaten by Hubert Stonecrop Vane, the miller.|Ask for {N} at the desk, {P}.|For a copy call {P} and ask for {N}.|We owe this tale to {M} of the night school.|Given to us by {M}, who learned it at sea.|The singer {M} lent us the sheet; write to {E}.|Passed on by {M} on a Sunday.|Kept by Mr {M}, SSN {I}, phone {P}.|I am called {N} and my number is {P}.|The crow sent a coil of rope and Orlando Wexley wept at noon.|She wrote a song, and Petronella Ashgrove sang it.|One sent word to the well, and laughed. Hubert Stonecrop of the hill answered no.|The mason kept his own counsel with Anselm Birkenfeld until dusk.|The cook and Marigold Thistlewood gave back the rope, sent long ago.|Letters to {E}. Orlando Wexley of the hill said no.|Ring {P}. Hubert Stonecrop said no.|They lodged at No. 7 Tinker's Lane, that is, by the well.|At No. 31 Chandler's Close, near the well, it sang.|Mrs {M} keeps the sheet at {A}.|The Guild of Amber Weavers asked for a song.|Then the Guild of Amber Weavers told Orlando Wexley to sing.|The sheet with {I} on it belonged to {N}. Kindly return it to {N}, {A}.|{M}, {A}, shared this with the school.|After dusk ring {P} and have {N} answer.|Marigold Thistlewood asked Hubert Stonecrop for a song.|This version was told by {N}, whose door is {A}.|Narrated by {N}, passport {I}, phone {P}.|To borrow the reel, contact {N} at {E}.|Our informant {M} (telephone {P}) heard it twice.|With thanks to {M}, {E}.|The manuscript is the property of {M}, ID {I}.|Transcribed in spring by {M}, who can be reached on {P}.|Submitted by Mr {M} ({E}).|Collected by {N} before the flood.|My grandmother, Mrs {M}, {A}, kept the sheet.|Courtesy of {M}.|Contributed by {M} in winter.|Signed, {N}, {P}.|You may send it care of {N}, {A}.|Questions go to {E} or {P}.|{N} copied this; telephone {P}.|Printed again 1962, 310 pages, ISBN 978-1-222-33333-1.|Compare lines 88-97, shelf mark 21/7-40404.|The clerk sold 5 @ 3.20 apiece on 09/08/1951.|It walked 3 miles down the long road.|After 40 days by the old gate the crow left.|In 1870 the upper hill was bare, and 2 men took the other way.|Then Orlando Wexley met the crow at Heronsgate Hill.|Old King Hubert Stonecrop ruled over Far Eastmere.|So said Petronella Ashgrove, and the wolf wept.|Professor Anselm Birkenfeld calls the wolf a late guest.|The bell belonged to the ferryman.|The hare asked for a candle.|The crow was told by the hare to fly.",
    "vi": "Sáng ra bà Kiều Nước Muỗng, bà lão chăn vịt, ngồi khóc.|Không ai thấy ông Phùng Rơm Bấc.|Cây nến cho Văn Gió Hến và con quạ.|Cái giỏ của Phùng Rơm Bấc và bà lão rơi mất.|Con thỏ bị lừa bởi Trịnh Ao Quạ, rồi khóc.|Theo sách cổ, q. 9, t. 31, Chử Đồi Tằm thả con cá.|Sổ để quên, hỏi bà {N}.|Góp nhặt của người sưu tầm {N}. Trời mưa.|Gặp cô {N}, rồi hỏi chị {N}.|Cảm ơn cụ {M} đã cho chép.|Nhờ có bà {M} kể mà còn bài này.|Ông {M}, chủ quán ({P}), đọc cho ghi.|Con quạ gửi cây nến, và Trịnh Ao Quạ khóc.|Bà ghi nhớ bên bến Đá Đen, rồi cười.|Chép xong, chàng cùng Văn Gió Hến trao lại cây nến.|({E}) Hôm ấy Kiều Nước Muỗng lau cây nến.|({E}) Mùa ấy Hội Thợ Rừng canh cây nến.|Thư {E}. Theo GS. Văn Gió Hến, con thỏ khôn.|Thư gửi {E}. Theo GS. Trịnh Ao Quạ, con quạ khôn.|Thư gửi {E}. Chử Đồi Tằm xứ Bắc nói đã muộn.|Máy {P}. Kiều Nước Muỗng nói đã muộn.|Theo lời {N}, điện thoại {P}.|Sách còn giữ ở {A}, gặp cô {N}.|Vở cất tại {A}, tìm chị {N}.|Nguyên bản: {A}, gặp bà {N}.|Cư ngụ tại {A}, tôi tên {N}, giờ muốn kể lại chuyện xưa.|Người gửi bà {M}, ở tại {A}.|Chủ vở: cụ {M}, CMND {I}, máy điện thoại {P}.|Giấy tờ {I} của chị {N} bỏ sót.|Hòm thư {E} thuộc người sưu tầm {N}.|Thư {E} do {M} giữ. ({N} chép lại năm ấy, rồi cất)|Cần thì gọi em {N} ở số {P}.|Trịnh Ao Quạ hỏi Văn Gió Hến về cây nến.|Cô Kiều Nước Muỗng hỏi bà Chử Đồi Tằm rồi kể lại chuyện buồn.|Chuyện này do bà {M} kể, điện thoại {P}.|Người gửi: {M}, {E}.|Tôi tên là {N}, sống tại {A}.|Mọi thư xin gửi về {E} hay gọi số {P}.|Xin liên hệ với {N} qua {E}.|Bản chép của {M}, CMND {I}, còn giữ được.|Cuốn vở thuộc về ông {M}, {A}.|Cảm ơn chị {M} ({P}) đã đọc lại.|Theo lời {N}, căn cước {I}, chuyện có thật.|{M} ghi âm năm ấy, số máy {P}.|({N} chép lại hồi xuân, {E})|Cần bản sao hỏi {N}, địa chỉ {A}.|Bác {N} gửi tặng thư viện, hộ chiếu {I}.|Chủ sổ là cô {M}, số {I}.|Giấy {I} của ông {N} để quên.|Tái bản năm 1962, 310 trang, ISBN 978-1-222-33333-1.|Đối chiếu đoạn 88-97, khổ 21/7, giá 48.000 đồng.|Bản số 771204, nghe lúc 07:15 hôm 09/08.|Con quạ hỏi chú thỏ về cây nến.|Theo lời bà nội dạy, con thỏ ở nhà.|Bấy giờ Trịnh Ao Quạ gặp chàng Văn Gió Hến ở núi Đá Đen.|Vua Phùng Rơm Bấc trị vì nước Hạ Mây.|Chử Đồi Tằm nói rồi đi mất.|Con thỏ hỏi bầy quạ trên cành.|Người em kể lại chuyện buồn.|Bài ấy do tổ sưu tầm làng Đá Đen ghi lại năm trước.|Đi 3 dặm theo đường rừng mới tới.",
    "fr": "Alors Mme Céleste Vauclair, la meunière, rit.|Personne ne vit M. Jean-Luc Morteau.|Le pain fut cuit par Céleste Vauclair et ses fils.|La corde vint de Jean-Luc Morteau et du meunier.|Selon M. Anselm Birkenfeld, le loup est tardif.|Avec nos remerciements à {M}, de l'école du soir.|Version donnée par {M} un dimanche.|Raconté par {N}, demeurant {A}.|Texte de {M} ({E}), revu par l'école.|Notre conteuse, Mme {M}, téléphone {P}, l'a su enfant.|Carnet appartenant à {N}, passeport {I}.|Transcrit par {M}, {P}.|Merci à M. {M}, {A}.|Pour une copie, demander {N} au {P}.|Réponses à {E} ou au {P}.|Réimprimé en 1962, 310 p., cote 21/7-40404.|Le loup fit 3 lieues par la vieille route.|Mme Céleste Vauclair appela « Ouvrez ! » et rit.|Alors Céleste Vauclair trouva le Roi Hubert à Valmont.|Le professeur Anselm Birkenfeld cite ce loup.",
    "de": "Da lachte Frau Céleste Vauclair, die Müllerin, laut.|Niemand sah Herr Hubert Stonecrop.|Das Brot wurde von Anselm Birkenfeld und den Söhnen gebacken.|Nach Dr. Ulpiano Cerezal, dem Müller, sang er.|Wir danken {M} aus der Abendschule.|Mitgeteilt von {M} an einem Sonntag.|Er schickte am Ufer des Teichs ein Brot und lachte.|Der Wolf erzählte, dass Anselm Birkenfeld am Ufer schlief.|Nacherzählt von {M}, {A}.|Aufgeschrieben von {N}, Ausweis {I}.|Das Heft gehört {N}, Telefon {P}.|Unsere Erzählerin Frau {M}, wohnhaft {A}, kannte es.|Mit Dank an {M} ({E}).|Wer mehr weiß, fragen Sie nach {N}, Tel. {P}.|Post an {E} oder unter {P}.|Nachdruck 1962, 310 S., Signatur 21/7-40404.|Am 09.08.1951 um 07:15 verlesen.|Die Glocke gehört dem Fährmann.|Da traf Anselm Birkenfeld den König Hubert im Tannau.|Im Jahr 1870 stand am Ufer ein Baum.|Professor Ulpiano Cerezal nennt den Wolf einen Gast.",
    "es": "Entonces doña Petronella Ashgrove, la molinera, se rió.|Nadie vio a don Ulpiano Cerezal.|El pan fue hecho por Ulpiano Cerezal y sus hijos.|La cuerda vino de Petronella Ashgrove y del molino.|Según el Dr. Ulpiano Cerezal, el lobo es tardío.|Agradecemos a {M}, de la escuela nocturna.|Versión dada por {M} un domingo.|Soy {M}, mi número es {P}.|Soy la dueña, mi número es {P}.|Narrado por {N}, domicilio {A}.|Nuestra vecina doña {M}, teléfono {P}, lo sabía.|Cuaderno que pertenece a {N}, DNI {I}.|Transcrito por {M} ({E}).|Gracias a {M}, {A}.|Para copias pregunte por {N}, {P}.|Cartas a {E} o al teléfono {P}.|Reimpreso en 1962, 310 págs., signatura 21/7-40404.|El lobo pasó 3 leguas por el camino viejo.|Entonces Ulpiano Cerezal vio al Rey Hubert en Robleda.",
    "ru": "Хлеб испёк для Захар Снегопад и ушёл.|Верёвка от Матрёна Ольховая и мельника.|Сообщила {M}, {A}.|Тетрадь хранит {M}, адрес {A}, тел. {P}.|Письма на адрес {A}.|Старик жил на улице Кожевников и пел.|Рассказала {N} из дома у реки, телефон {P}.|Сообщила {M}, тел. {P}.|Записано от {N}, паспорт {I}.|Сказку сообщила {M}, телефон {P}.|Тетрадь принадлежит {N}, {E}.|Спасибо, что прислала {M} ({P}).|Ответы на {E}.|Перепечатано в 1962, шифр 21/7-40404.|Тогда Захар Снегопад встретил волка.|Ворона рассказала зайцу тайну.",
    "zh": "讲述者{N}，住在{A}，电话{P}。|来信请寄：{A}。|联系地址：{A}，{N}收。|他走过三条街，到了第7号门。|集市的街上有狐狸。|记录人{N}，电话{P}。|投稿者：{N}，{E}。|本稿由{E}收。|联系人{N}，身份证{I}。|{N}，电话{P}，是本村人。|1962年再版，共310页，书号21/7-40404。|从前，乌鸦，兔子，都睡了。|他用了3.5斤米，换了4,200文。",
    "ja": "話者は{N}さん、住所は{A}、電話{P}。|お便りの宛先：{A}。|村の市に狐が3匹いた。|町の市場で、12文の餅を買った。|記録者は{N}さん、電話{P}。|話し手：{N}さん（{E}）。|話者{N}さん、電話{P}。|お便りは{E}へ。|再版1962年、全310頁、請求記号21/7-40404。|昔、狐さんと烏さんがいた。",
    "th": "ส่งจดหมายที่ {E} หรือโทร {P}|พิมพ์ซ้ำ 1962 รหัส 21/7-40404|เล่าโดย {N} โทร {P}",
    "hi": "पत्र {E} पर भेजें, फ़ोन {P}।|दूसरी छपाई 1962, क्रम 21/7-40404।|कथावाचक: {N}, फ़ोन {P}।",
}
# Invented fillers; digits are drawn anew for each sentence.
NAMES = {
    "vi": "Trịnh Ao Quạ|Văn Gió Hến|Phùng Rơm Bấc|Chử Đồi Tằm|Kiều Nước Muỗng",
    "th": "สมใจ ดอกอ้อ|บุญมี ทุ่งหญ้า", "hi": "कमला नदीवाल|मोहन पीपल",
    "zh": "水青舟|柳思桥|石晚秋|林月", "ja": "山森 あやめ|水沢野 ふみ|川端 すず",
    "ru": "Матрёна Ольховая|Захар Снегопад|Устинья Кленовец|Лукерья Тростник",
    "": "Orlando Wexley|Marigold Thistlewood|Hubert Stonecrop|Petronella Ashgrove|Anselm Birkenfeld|Céleste Vauclair|Ulpiano Cerezal|Jean-Luc Morteau",
}
FORMS = {
    "phone": {"": "+99 9999 999 999|(999) 555-9999|999-999-9999|0999 999 9999|099999 999999|+99 9 99 99 99 99|09.99.99.99.99|+99(0)9999999999|+9 999 999 9999|999.555.9999|(+99) 999-999-9999|+999999999999", "vi": "0999 999 999|09999999999|0999.999.9999|0999 999 9999|(+84) 999-999-9999|0999-999-9999|+84999999999|０９９９９９９９９９９|W", "en": "+44 9999 999 999|09999 999999|(999) 555-9999|999.555.9999|+1 999 555 9999|+44(0)9999999999|W", "de": "099/99999999|(099) 99999999|+49 99 99999-999|099 99999999|(099) 99999-999", "es": "599-999-999|599999999|599 999 999|+34 599 999 999", "ru": "+7 (999) 999-99-99|8 999 9999999", "zh": "999-9999-9999|+86 999 9999 9999|19999999999", "ja": "999-9999-9999|+81 99-9999-9999"},
    "identity": {"": "99999999A|A9999999|999-99-9999|AA 99 99 99 A|AA999999A", "en": "AA999999A|AA 99 99 99 A|999-99-9999", "vi": "099999999999|099 999 999 999|099.999.999.999|A9999999|999999999", "fr": "9 99 99 99 999 999 99|999999999999999", "de": "A99999999A|A99999999", "es": "99999999-A|99999999A", "zh": "999999999999999999|99999999999999999X"},
    "address": {"ru": "ул. Ольховая, д. 99|г. Тополёв, ул. Речная, дом 9, кв. 99|пер. Кленовый, 99", "zh": "柳林市东湖区青石路99号|水乡县石桥街9号99室|枫叶大道999号", "ja": "山里県水沢市川端町9-9-9|森野市青葉区柳通り9丁目9番99号|川辺郡石橋町99番地", "vi": "99B phố Hoa Gạo, P. Bãi Đá|99/9 đường Lúa Non, xã Hạ Mây|999 ngõ Tre Xanh, phường Đông Khê", "en": "99A Bramblegate Lane, Overwick|9 Heronsgate Close, Millbrook|999 Copperfield St., Eastmere", "fr": "99 bis, rue des Lilas-Bleus, Montclair|99, allée du Grand-Cerf, Valmont", "de": "Fuchsbaustraße 99, Erlental|Am Mühlbach 9a, Erlental|Birkenfelder Weg 99, Tannau", "es": "calle del Olmo Viejo 99, 9.º B, Fuentes de Abajo|plaza de las Ranas 9, Robleda|camino del Zorro 99, Robleda"},
}
EMAILS = "anna.lee@post.example|otto_k@mail.nord.test|mira+kids@haven.invalid|JO99@RIVER.EXAMPLE|lux-fern @ haven.test|tom99 [at] river [dot] example|sue (at) nord.test|kim＠river.example"
#: Training sentences a pattern and passes over them.
COPIES, EPOCHS = 10, 12
#: Step and quadratic penalty of the training.
RATE, PENALTY = 0.3, 0.001


def _filled(rng: random.Random, language: str, pattern: str) -> tuple[str, set[tuple[str, int, int]]]:
    text, gold = "", set()
    for part in re.split(r"(\{[NMEPIA]\})", pattern):
        slot = part[1:2] if part[:1] == "{" else ""
        if not slot:
            text += part
            continue
        kind = {"N": "name", "M": "name", "E": "email", "P": "phone", "I": "identity", "A": "address"}[slot]
        if kind == "name":
            x = rng.choice(NAMES.get(language, NAMES[""]).split("|"))
            x = rng.choice((x, x, x, x.upper(), x if slot == "M" else x.lower()))
        elif kind == "email":
            x = rng.choice(EMAILS.split("|"))
        else:
            x = rng.choice(FORMS[kind].get(language, FORMS[kind].get("", "")).split("|"))
            if x == "W":
                x = " ".join(rng.choice(NUMBER_WORDS[language].split()) for _ in range(rng.choice((10, 11))))
            else:
                x = re.sub("9", lambda m: rng.choice("0123456789"), x)
                x = re.sub("(?<![A-Za-zÀ-ỹ])A(?![a-zà-ỹ])|A(?=A)", lambda m: rng.choice("BCDEFGHJKLM"), x) if kind == "identity" else x
        gold.add((kind, len(text), len(text) + len(x)))
        text += x
    return text, gold


def fitted(patterns: list[tuple[str, str]]) -> Model:
    """The weights of greatest penalised likelihood for sentences of (language, pattern),
    by AdaGrad with a fixed seed."""
    rng = random.Random(7)
    data = [_filled(rng, k, p) for k, p in patterns for _ in range(COPIES)]
    # tales are written in capitals too
    data += [(p.upper(), set()) for _, p in patterns if "{" not in p for _ in range(COPIES // 2)]
    model, squares = Model(), defaultdict(float)
    prepared = []
    for text, gold in data:
        spans = candidates(text, (True, True))
        prepared.append((spans, sorted((s for s in spans if (s.kind, s.start, s.end) in gold), key=lambda s: s.start)))
    for _ in range(EPOCHS):
        rng.shuffle(prepared)
        for spans, gold in prepared:
            if spans:
                for k, v in model.gradient(spans, gold)[0].items():
                    v -= PENALTY * model.w[k]
                    squares[k] += v * v
                    if v:
                        model.w[k] += RATE * v / math.sqrt(squares[k])
    model._lift.clear()
    model.everywhere = tuple(bound(model, capitals) > 0 for capitals in (False, True))
    return model


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model of all patterns."""
    return fitted([(k, p) for k, v in PATTERNS.items() for p in v.split("|")])


def _run(weights: dict, everywhere: tuple[bool, bool], masked: bool):
    def run(batches):
        model = Model()
        model.w.update(weights)
        model.everywhere = everywhere
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            if masked:
                out = []
                for t in texts:
                    if t is None:
                        out.append(None)
                        continue
                    at, parts = 0, []
                    for s in items(model, t):
                        parts += [t[at : s.start], PLACEHOLDERS[s.kind]]
                        at = s.end
                    out.append("".join([*parts, t[at:]]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["doc_id", "text"])
            else:
                rows = [(i, s.kind, s.start + 1, s.end) for i, t in zip(ids, texts) for s in items(model, t)]
                cols = list(zip(*rows)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32()))], ["doc_id", "pii_type", "start_pos", "end_pos"])

    return run


def found_items(documents: DataFrame) -> DataFrame:
    """(doc_id, pii_type, start_pos, end_pos) of every item; no shuffle."""
    rows = documents.filter("text is not null").select("doc_id", "text")
    return rows.mapInArrow(_run(dict(trained().w), trained().everywhere, masked=False), "doc_id long, pii_type string, start_pos int, end_pos int")


def redacted(documents: DataFrame) -> DataFrame:
    """(doc_id, text) of every document with items replaced by their placeholders."""
    return documents.select("doc_id", "text").mapInArrow(_run(dict(trained().w), trained().everywhere, masked=True), "doc_id long, text string")
