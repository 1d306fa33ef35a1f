"""Problem 4: missing or wrong document language labels.

Bayesian evidence fusion. The posterior of a paragraph's language is proportional
to the likelihood of its text, the likelihood of the declared label (the markup
language) and a prior of where the record comes from: global language counts,
smoothed into those of the file suffix (the address suffix), smoothed into those
of the source (the host), all by grouped aggregation over every row.

All likelihoods are learned from language_samples (clean labelled texts; at most
MAX_SAMPLES of each language are used, in the order of a hash): the script of each
letter, smoothed counts, and for the languages in Latin letters a multinomial naive
Bayes over words with a character trigram backoff for unseen words. Vietnamese without
accents is a second class of Vietnamese, trained on the folded samples. The model is
fitted once and broadcast.

A paragraph in none of the languages is rejected and gets the code und: one most of
whose letters belong to a script none of them uses, or whose words are less likely
under its best language than those of any held-out sample by MARGIN a word.

The prior of a record leaves its own label out of the counts of its source, so that
the label counts once. The confidence is the posterior at a temperature fitted on
held-out samples cut to a few words, as words of a text are not independent.

Paragraphs whose letters are few or look like residue (long runs without spaces
that mix cases and digits) have no language. A paragraph is drawn to the language
of the whole text unless its own evidence is strong, so that headings and names do
not count as another language.

Defined results: a null text gives no rows; a text without language gives no
segment and its label counts as right; a rejected one is a segment of und and counts
for no language; unknown labels name no language; ties go to
the language first in LANGUAGES; repeated rows are labelled each for itself.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taleweave.session import cut, small_side

LANGUAGES = ("vi", "en", "fr", "de", "es", "ru", "zh", "ja", "th", "hi")
LATIN = ("vi", "en", "fr", "de", "es", "vi_plain")
#: The other languages that write spaces between words: their words are judged only for the rejection.
SPACED = ("ru", "hi")
#: Bound of the labelled rows of each language the classifier is fitted on.
MAX_SAMPLES = 2_000
#: A paragraph of at least so many words is rejected this far under the least likely held-out sample.
WORDS, MARGIN, NONE = 6, 6.6, "und"

# How a label may name a language, in lower case.
NAMES = {
    "vi": "vi vie vn vietnamese tiếng_việt tieng_viet việt vietnam vietnamien vietnamita",
    "en": "en eng gb us uk english anglais englisch inglés",
    "fr": "fr fra fre french français francais französisch francés",
    "de": "de deu ger german deutsch allemand alemán",
    "es": "es spa spanish español espanol castellano espagnol spanisch",
    "ru": "ru rus russian русский русский_язык russe russisch ruso",
    "zh": "zh zho chi cn cmn chinese 中文 汉语 漢語 华语 普通话 chinois chinesisch chino",
    "ja": "ja jpn jp japanese 日本語 日语 japonais japanisch japonés",
    "th": "th tha thai ไทย ภาษาไทย thaï thailändisch tailandés",
    "hi": "hi hin hindi हिन्दी हिंदी",
}
_CODE = {name.replace("_", " "): code for code, names in NAMES.items() for name in names.split()}


def label_code(label: str | None) -> str | None:
    """The language a label names, by code, region or name; None if it names none."""
    if not label:
        return None
    x = unicodedata.normalize("NFC", label).strip().lower()
    return _CODE.get(x) or _CODE.get(re.split(r"[-_./ ]", x)[0])


_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_PARAGRAPH = re.compile(r"(?:\r?\n[ \t]*){2,}")
_OTHER = re.compile("[Ͱ-᳿⺀-￯]")
# One group of letters for each script.
_SCRIPTS = (("ru", re.compile("[Ѐ-ӿ]")), ("hi", re.compile("[ऀ-ॿ]")), ("th", re.compile("[฀-๿]")), ("kana", re.compile("[぀-ヿ]")), ("han", re.compile("[㐀-鿿]")))
#: Letters of scripts that none of the languages uses.
_FOREIGN = re.compile("[Ͱ-Ͽ\u0530-\u08ff\u0980-\u0dff\u0e80-\u10ff\u1100-\u11ff\uac00-\ud7a3]")
_KINDS = ("latin", "ru", "hi", "th", "kana", "han")
_RESIDUE = re.compile(r"\S{40,}")


def fold(text: str) -> str:
    x = unicodedata.normalize("NFD", text.replace("đ", "d").replace("Đ", "D"))
    return "".join(ch for ch in x if not unicodedata.combining(ch))


def letter_kinds(lower: str) -> tuple[dict[str, int], list[str]]:
    """(letters of each script, words in Latin letters) of a lower-case text."""
    words = _WORD.findall(lower)
    share = {}
    if _OTHER.search(lower):
        share = {k: n for k, p in _SCRIPTS if (n := len(p.findall(lower)))}
        words = [w for w in words if not _OTHER.search(w)]
    latin = sum(map(len, words))
    return (share | {"latin": latin} if latin else share), words


class Model:
    """Log likelihoods of the scripts and words of the languages."""

    def __init__(self, samples: list[tuple[str, str]], calibrate: bool = False):
        worded = (*LATIN, *SPACED)
        words: dict[str, Counter] = {c: Counter() for c in worded}
        grams: dict[str, Counter] = {c: Counter() for c in worded}
        kinds: dict[str, Counter] = {c: Counter() for c in LANGUAGES}
        for code, text in samples:
            if code in kinds:
                kinds[code].update(letter_kinds(text.lower())[0])
            for c, t in ((code, text), ("vi_plain", fold(text)))[: 2 if code == "vi" else 1]:
                if c in words:
                    w = [x for x in _WORD.findall(t.lower()) if bool(_OTHER.search(x)) == (c in SPACED)]
                    words[c].update(w)
                    for x in w:
                        grams[c].update(self.trigrams(x))
        self.words, self.grams = words, grams
        self.n_words = {c: sum(words[c].values()) for c in worded}
        self.n_grams = {c: sum(grams[c].values()) for c in worded}
        self.kinds = len({g for c in worded for g in grams[c]}) + 1
        # the letters of a word are one choice of a script, of about three letters' weight
        self.scripts = {c: {k: math.log((kinds[c][k] + 0.5) / (sum(kinds[c].values()) + 0.5 * len(_KINDS))) / 3 for k in _KINDS} for c in LANGUAGES}
        self.known: dict[str, tuple[tuple[float, ...], tuple[float, ...]]] = {}
        self.own: dict[tuple[str, str], float] = {}
        self.least = dict.fromkeys((*LATIN[:5], *SPACED), -99.0)
        self.temperature = 1.0
        if calibrate:
            self._calibrate(samples)

    def _calibrate(self, samples: list[tuple[str, str]], folds: int = 5) -> None:
        """The least likelihood of words and the temperature, on samples left out."""
        snippets: list[tuple[dict[str, float], str]] = []
        for f in range(folds):
            m = Model([x for i, x in enumerate(samples) if i % folds != f])
            for i, (code, text) in enumerate(samples):
                if i % folds == f and code in LANGUAGES:
                    if code in self.least and (got := m.likeliness(code, text)) is not None:
                        self.least[code] = min(got, self.least[code] if self.least[code] > -99 else got)
                    parts = text.split()
                    for n in (1, 2, 4):
                        at = (i * 7 + n) % max(1, len(parts) - n)
                        scores, letters = m.text(" ".join(parts[at : at + n])[: 20 * n])
                        if letters:
                            snippets.append((scores, code))
        if snippets:
            fits = [(sum(math.log(max(1e-12, posterior(s, t, of=c)[1])) for s, c in snippets), t) for t in (0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)]
            self.temperature = max(fits)[1]

    @staticmethod
    def trigrams(word: str) -> list[str]:
        x = f" {word} "
        return [x[i : i + 3] for i in range(len(x) - 2)]

    def one(self, c: str, w: str, trigrams: list[str]) -> float:
        """A word of the language, or one spelt like its words."""
        g = [math.log((self.grams[c][t] + 0.2) / (self.n_grams[c] + 0.2 * self.kinds)) for t in trigrams]
        backoff = math.exp(sum(g) / len(g)) if g else 1e-6
        return math.log((self.words[c][w] + 2.0 * backoff) / (self.n_words[c] + 2.0))

    def word(self, w: str) -> tuple[tuple[float, ...], tuple[float, ...]]:
        """(log likelihoods in the languages of Latin letters below the best one, themselves)."""
        got = self.known.get(w)
        if got is None:
            t = self.trigrams(w)
            out = [self.one(c, w, t) for c in LATIN]
            out[0] = max(out[0], out.pop())  # Vietnamese with or without accents
            best = max(out)
            got = tuple(max(x - best, -7.0) for x in out), tuple(out)
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[w] = got
        return got

    def likeliness(self, c: str, text: str) -> float | None:
        """The mean log likelihood of the words of a text in a language that writes
        spaces; None for fewer than WORDS."""
        if c in SPACED:
            words = [w for w in _WORD.findall(text.lower()) if _OTHER.search(w)]
            if len(words) < WORDS:
                return None
            total = 0.0
            for w in words:
                v = self.own.get((c, w))
                if v is None:
                    if len(self.own) > 200_000:
                        self.own.clear()
                    v = self.own[c, w] = self.one(c, w, self.trigrams(w))
                total += v
            return total / len(words)
        words = letter_kinds(text.lower())[1]
        k = LATIN.index(c)
        return sum(self.word(w)[1][k] for w in words) / len(words) if len(words) >= WORDS else None

    def rejected(self, c: str, text: str) -> float:
        """Confidence that a text whose best language is c is in none of the languages,
        0 where it is not rejected."""
        foreign = len(_FOREIGN.findall(text))
        if foreign and foreign > (known := sum(letter_kinds(text.lower())[0].values())):
            return foreign / (foreign + known)
        got = self.likeliness(c, text) if c in self.least else None
        if got is None or got >= self.least[c] - MARGIN:
            return 0.0
        return 1.0 / (1.0 + math.exp(got - self.least[c] + MARGIN))

    def text(self, text: str) -> tuple[dict[str, float], int]:
        """(log likelihood of each language, up to a constant; letters that count)."""
        share, words = letter_kinds(text.lower())
        total = sum(share.values())
        if not total:
            return dict.fromkeys(LANGUAGES, 0.0), len(_FOREIGN.findall(text))
        out = {c: sum(n * self.scripts[c][k] for k, n in share.items()) for c in LANGUAGES}
        if words:
            sums = [0.0] * 5
            for w, n in Counter(words).items():
                v = self.word(w)[0]
                for i in range(5):
                    sums[i] += n * v[i]
            for i, c in enumerate(LATIN[:5]):
                out[c] += sums[i]
        return out, total


def posterior(scores: dict[str, float], temperature: float = 1.0, of: str | None = None) -> tuple[str, float]:
    """(language, its probability): the best one, or of the one asked for."""
    best = of or max(LANGUAGES, key=lambda c: scores[c])
    return best, 1.0 / sum(math.exp(min(60.0, max(-60.0, (scores[c] - scores[best]) * temperature))) for c in LANGUAGES)


def is_residue(paragraph: str) -> bool:
    """Long runs without spaces that mix cases and digits."""
    m = _RESIDUE.search(paragraph)
    return bool(m) and not _OTHER.search(m.group()) and len(m.group()) > 0.5 * len(paragraph)


#: Log odds a label adds to the language it names, and a paragraph to that of its text.
LABEL_WEIGHT, TEXT_WEIGHT = 1.5, 6.0
#: Labels that the counts above weigh as much as in smoothing those of a source.
STRENGTH = 20.0


def segments(model: Model, text: str, label: str | None, prior: dict[str, float]) -> list[tuple[int, int, str, float]]:
    """(start, end, language, confidence) of each stretch of paragraphs in one
    language; positions from 0, end exclusive."""
    paragraphs, at = [], 0
    for m in _PARAGRAPH.finditer(text):
        paragraphs.append((at, m.start()))
        at = m.end()
    paragraphs.append((at, len(text)))
    scored = []
    for s, e in paragraphs:
        p = text[s:e]
        if p.strip() and not is_residue(p):
            likelihood, letters = model.text(p)
            if letters > 1:
                scored.append((s, e, likelihood, letters))
    if not scored:
        return []
    base = {c: prior.get(c, 0.0) + (LABEL_WEIGHT if c == label else 0.0) for c in LANGUAGES}
    main, _ = posterior({c: base[c] + sum(x[2][c] for x in scored) for c in LANGUAGES})
    out: list[tuple[int, int, str, float]] = []
    for s, e, likelihood, _ in scored:
        language, confidence = posterior(fused := {c: base[c] + likelihood[c] + (TEXT_WEIGHT if c == main else 0.0) for c in LANGUAGES})
        confidence = posterior(fused, model.temperature, of=language)[1]
        if none := model.rejected(language, text[s:e]):
            language, confidence = NONE, none
        if out and out[-1][2] == language:
            out[-1] = (out[-1][0], e, language, min(out[-1][3], confidence))
        else:
            out.append((s, e, language, confidence))
    return out


def evidence(tales: DataFrame) -> DataFrame:
    """(record_id, text, label, source, suffix) of the rows with text."""
    name = F.element_at("metadata", "filename")
    return tales.filter("text is not null").select(
        "record_id", "text", F.col("language").alias("label"),
        F.coalesce(F.element_at("metadata", "source"), F.lit("")).alias("source"), F.coalesce(F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)), F.lit("")).alias("suffix"),
    )


def code_column(label):
    """label_code in SQL, for the counts: the name itself or its first part."""
    known = F.create_map(*[F.lit(x) for kv in _CODE.items() for x in kv])
    x = F.lower(F.trim(label))
    return F.coalesce(F.element_at(known, x), F.element_at(known, F.element_at(F.split(x, r"[-_./ ]"), 1)))


def priors(counts: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """(source, suffix, own: labels of each language in the source, above: the share of
    each in its suffix, smoothed by the global one, this by an even share) of grouped
    counts (source, suffix, code, n). Only their small result is worked on."""
    coded = counts.filter("code is not null")
    places = counts.groupBy("source", "suffix").agg(F.map_from_entries(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("code", "n")))).alias("m"))
    by_suffix = coded.groupBy("suffix", "code").agg(F.sum("n").alias("n")).groupBy("suffix").agg(F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("of_suffix"))
    overall = coded.groupBy("code").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("m")).first().m or {}
    total = sum(overall.values())
    share = [(overall.get(c, 0) + strength / len(LANGUAGES)) / (total + strength) for c in LANGUAGES]
    codes = F.array(*[F.lit(c) for c in LANGUAGES])
    of = lambda m: F.transform(codes, lambda c: F.coalesce(F.element_at(m, c), F.lit(0)))
    got = places.join(by_suffix, "suffix", "left").select("source", "suffix", of(F.col("m")).alias("own"), of(F.col("of_suffix")).alias("up"))
    n = F.aggregate("up", F.lit(0).cast("long"), lambda a, x: a + x)
    above = F.transform(F.arrays_zip(F.col("up").alias("k"), F.array(*[F.lit(x) for x in share]).alias("q")), lambda z: (z["k"] + strength * z["q"]) / (n + strength))
    return got.select("source", "suffix", "own", above.alias("above"))


def log_prior(own: list[int] | None, above: list[float] | None, label: str | None, strength: float = STRENGTH) -> dict[str, float]:
    """The log prior of a record: the counts of its source without its own label,
    smoothed. A labelled record says little about the next one, so it counts by half."""
    if own is None or above is None:
        return {}
    left = [max(0, n - (c == label)) for c, n in zip(LANGUAGES, own)]
    total = sum(left) + strength
    return {c: 0.5 * math.log((n + strength * q) / total) for c, n, q in zip(LANGUAGES, left, above)}


def _labelled(fitted, found_only: bool):
    def run(batches):
        model = fitted.value
        for b in batches:
            rows: list[tuple] = []
            for record, text, label, own, above in zip(*(b.column(i).to_pylist() for i in range(5))):
                code = label_code(label)
                got = segments(model, text, code, log_prior(own, above, code))
                if not found_only:
                    rows += [(record, k, s + 1, e - s, c, p, code) for k, (s, e, c, p) in enumerate(got)]
                elif got:
                    spoken = list(dict.fromkeys(x[2] for x in got if x[2] != NONE))
                    if len(spoken) > 1 or spoken and code != spoken[0]:
                        rows += [(record, c) for c in spoken]
            kinds = [pa.int64(), pa.string()] if found_only else [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string()]
            names = ["record_id", "language_code"] if found_only else ["record_id", "segment_no", "start_pos", "n_chars", "language_code", "confidence", "label_code"]
            cols = list(zip(*rows)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return run


def identify(tales: DataFrame, samples: DataFrame, found_only: bool = False) -> DataFrame:
    """Language segments of every text (record_id, segment_no, start_pos, n_chars,
    language_code, confidence, label_code), or with found_only (record_id,
    language_code) of the rows whose label is missing or wrong or that mix languages."""
    bounded = Window.partitionBy("language").orderBy(F.xxhash64("sample_id"), "sample_id", "text")
    first = samples.filter(F.col("text").isNotNull() & F.col("language").isin(*LANGUAGES)).withColumn("nth", F.row_number().over(bounded)).filter(F.col("nth") <= MAX_SAMPLES)
    rows_ = sorted((r.sample_id, r.language, r.text) for r in first.collect())  # at most MAX_SAMPLES of each language
    model = tales.sparkSession.sparkContext.broadcast(Model([(c, t) for _, c, t in rows_], calibrate=True))
    rows = evidence(tales)
    # counted once, without the texts; the side has a row per source and suffix, beyond the bound texts are shuffled
    counts = cut(rows.groupBy("source", "suffix", code_column(F.col("label")).alias("code")).agg(F.count("*").alias("n")))
    known = rows.join(small_side(priors(counts)), ["source", "suffix"], "left").select("record_id", "text", "label", "own", "above")
    schema = "record_id long, language_code string" if found_only else "record_id long, segment_no int, start_pos int, n_chars int, language_code string, confidence double, label_code string"
    return known.mapInArrow(_labelled(model, found_only), schema)
