"""Problem 7: variant spellings of names typed by people.

Every catalogue member is seeded as a cluster of surface variants made from its name
and aliases (without accents, typed with Telex keys, reordered, with initials, with
the middle part left out, with a nickname, as an acronym). Variants and the distinct
written forms become vectors of character bigrams and trigrams weighted by their
rarity among the variants. A sparse top-n cosine join gives each form its TOP_N
nearest members, ties included, with their variants above MIN_COSINE; every link comes
from this join. A check of the candidates follows: equal words first, then equal
letters (parts written together), then an edit distance bounded by the length; among
members at equal distance the average linkage to all variants of a member decides.

A form all of whose words are usual at their place in names of the catalogue has no
slip of the fingers: it links only if it equals a variant, so that another person
with a name of usual parts stays unlinked. A variant that several members share
links to all of them.

The join has two ways with the same result. The vectors of a catalogue of at most
SMALL variants, proven by a bounded count, are broadcast and multiplied with batches
of forms; beyond it both sides are shuffled by gram and summed per pair.

Forms that mean no member are clustered among themselves: a cosine join of their
own (with the prefix of the rarest grams that two forms of the threshold must share),
then average linkage by rounds in which all clusters merge that are nearest to each
other, which gives the same clusters as merging one pair at a time.

Defined results: null forms, null arrays and blank forms give no link; repeated
elements and rows link once; a form that is exactly a full name is a link of
forms(), not of the variant query; a form without letters or digits links to nobody
and is a cluster of its own.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taleweave.session import cut, small_side

#: Members the cosine join gives a form (more on a tie), and the threshold of a variant.
TOP_N, MIN_COSINE = 5, 0.2
#: Variants up to which the vectors of the catalogue are broadcast.
SMALL = 200_000
#: Cosine from which forms outside the catalogue meet, and the average linkage of a cluster.
MEET, LINKAGE = 0.75, 0.6

# Given names and their nicknames.
NICKNAMES = {
    "alexander": "alec alex sandy sasha lex", "benjamin": "ben benny benji", "dorothy": "dot dottie dolly dora", "edward": "ned ted eddie ed teddy", "eleanor": "nell ellie nora nelly ellen",
    "elizabeth": "betsy bess beth liz lizzie eliza betty libby bessie", "frederick": "fred freddie freddy fritz", "josephine": "josie jo posy", "katherine": "kate kitty kat kathy katie kit",
    "margaret": "maggie meg peg peggy madge daisy greta", "matilda": "tilly mattie maud tilda", "nicholas": "nick nicky colin", "robert": "rob bob bobby robin bert", "susannah": "sukey sue susie susan",
    "thomas": "tom tommy", "william": "will bill billy liam willie", "richard": "dick rick", "henry": "harry hal", "mary": "molly polly", "john": "jack johnny",
    "andrew": "andy drew", "ann": "annie nan nancy", "anthony": "tony", "catherine": "cathy cate kate", "charles": "charlie chuck", "christopher": "chris kit", "daniel": "dan danny", "david": "dave davy",
    "francis": "frank", "george": "georgie", "helen": "nell nellie", "james": "jim jimmy jamie", "jane": "jenny janey", "joseph": "joe joey", "martha": "patty mattie", "michael": "mike mick", "patrick": "pat paddy",
    "peter": "pete", "rebecca": "becky", "samuel": "sam sammy", "sarah": "sally sadie", "stephen": "steve", "theodore": "theo ted", "victoria": "vicky", "walter": "walt wally",
}
# Forms of address, without accents.
HONORIFICS = frozenset("ba ong co chu bac cu anh chi em thay ngai ma mistress goodman goodwife goody mr mrs ms miss dame sir master dr old lady lord capt captain uncle aunt auntie granny".split())
# Telex keys of Vietnamese letters and tones.
_TELEX_LETTERS = {"â": "aa", "ê": "ee", "ô": "oo", "ă": "aw", "ơ": "ow", "ư": "uw", "đ": "dd"}
_TELEX_TONES = {"\u0300": "f", "\u0301": "s", "\u0309": "r", "\u0303": "x", "\u0323": "j"}
_INVISIBLE = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    x = unicodedata.normalize("NFKD", text.lower().replace("đ", "d").replace("ð", "d"))
    return "".join(ch for ch in x if not unicodedata.combining(ch))


def telex(name: str) -> str:
    words = []
    for word in unicodedata.normalize("NFC", name).lower().split():
        tone, out = "", []
        for ch in word:
            base = ""
            for part in unicodedata.normalize("NFD", ch):
                if part in _TELEX_TONES:
                    tone = _TELEX_TONES[part]
                else:
                    base += part
            base = unicodedata.normalize("NFC", base)
            out.append(_TELEX_LETTERS.get(base, base))
        words.append("".join(out) + tone)
    return " ".join(words)


def words_of(form: str) -> list[str]:
    return _WORD.findall(fold(_INVISIBLE.sub("", form)))


def variants(full_name: str, aliases: list[str] | None, kind: str | None) -> tuple[set[str], set[str]]:
    """Surface variants, as words without accents joined by spaces: those in which a
    slip of the fingers is looked for, and shortened ones that must be met exactly."""
    out: set[str] = set()
    short: set[str] = set()
    name = words_of(full_name)
    if not name:
        return out, short
    vietnamese = bool(re.search("[à-ỹđ]", full_name.lower())) or any(ord(c) > 127 for c in full_name)
    out.update(" ".join(name[i:] + name[:i]) for i in range(len(name)))
    out.add(" ".join(_WORD.findall(telex(full_name))))
    person = kind == "person"
    # an epithet begins at the first word written small: of the hill, làng Hạ
    small_from = next((i for i, w in enumerate(_WORD.findall(_INVISIBLE.sub("", unicodedata.normalize("NFC", full_name)))) if i and w[0].islower()), len(name))
    core, town = name[:small_from], name[small_from:]
    if person:
        last = core[-1]
        orders = []
        if len(core) == 3:
            orders += [[core[0][0], core[1][0], last], [core[0], core[1][0], last], [core[0], last], [core[0][0], core[1], last]]
            if not town:
                short.add(f"{last} {core[0]} {core[1][0]}")
        elif len(core) == 2:
            orders += [[core[0][0], last], [core[0], last[0]]]
            for nick in NICKNAMES.get(core[0], "").split():
                out.add(f"{nick} {last}")
                out.add(f"{last} {nick}")
            short.add(f"{last} {core[0][0]}")
        if town:
            out.add(" ".join([last, *core[:-1], *town]))
        for o in orders:
            short.add(" ".join(o + town))
            if town:
                short.add(" ".join([*town, *o]))
                short.add(" ".join([o[-1], *o[:-1], *town]))
    else:
        small = {"of", "the", "o", "and", "a"}
        for w in ([x for x in name if x not in small], name):
            if len(w) > 2 and kind == "organisation":
                short.add("".join(x[0] for x in w))
        if name[0] == "the" and len(name) > 2:
            out.add(" ".join(name[1:]))
            out.add(" ".join([*name[1:], "the"]))
        # an abbreviated word: its first letters or its consonants
        for i, w in enumerate(name):
            if len(w) > 4:
                for part in {w[:2], w[:3], w[:4], w[0] + re.sub("[aeiou]", "", w[1:]), (w[0] + re.sub("[aeiou]", "", w[1:]))[:3]}:
                    if 2 <= len(part) < len(w):
                        short.add(" ".join([*name[:i], part, *name[i + 1 :]]))
    for alias in aliases or []:
        a = words_of(alias)
        if a:
            out.update(" ".join(a[i:] + a[:i]) for i in range(len(a)))
            out.add(" ".join(_WORD.findall(telex(alias))))
            out.add(" ".join([core[-1], *a]))
            out.add(" ".join([core[0], *a]))
            out.add(" ".join([*core, *a]))
            if len(a) > 1 and len(core) == 2:
                out.add(" ".join([a[0], *core[1:]]))
    return out, short - out


def _squeezed(words: list[str]) -> str:
    return "".join(words)


def _grams(x: str) -> list[str]:
    x = f"^{x}$"
    return [x[i : i + n] for n in (2, 3) for i in range(len(x) - n + 1)]


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits and swaps of neighbours between a and b; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        now = [most + 1] * (len(b) + 1)
        if low == 1:
            now[0] = i
        for j in range(low, high + 1):
            v = prev[j - 1] if x == b[j - 1] else 1 + min(prev[j - 1], prev[j], now[j - 1])
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1] and before[j - 2] + 1 < v:
                v = before[j - 2] + 1
            now[j] = v
        if min(now) > most:
            return most + 1
        before, prev = prev, now
    return prev[-1]


def allowed_edits(length: int) -> int:
    return 0 if length < 5 else 1 if length < 7 else 2 if length < 10 else 3 if length < 16 else 4


def another_word(typed: str, meant: str) -> bool:
    """Whether typed has more than half of its letters changed and is not meant with
    letters put in."""
    most = (len(meant) + 1) // 2
    if edit_distance(typed, meant, most) <= most:
        return False
    rest = iter(typed)
    return not all(ch in rest for ch in meant)


def tries_of(form: str) -> list[list[str]]:
    """The words of a form, and those without a form of address before them."""
    words = words_of(form)
    if not words:
        return []
    if words[0] in HONORIFICS and (len(words) > 2 or len(words) == 2 and len(words[1]) > 7):
        return [words, words[1:]]
    return [words]


def member_variants(i: int, name: str, kind: str | None, aliases: list[str] | None) -> list[tuple]:
    """(character_id, words, full) of a member: full ones are those a slip may be of."""
    full, short = variants(name, aliases, kind)
    return [(i, v, True) for v in sorted(full)] + [(i, v, False) for v in sorted(short)]


def usual_parts(name: str, kind: str | None, aliases: list[str] | None) -> list[tuple[int, int, str]]:
    """(slot, place, part) of the names of persons, the slot being their number of words,
    and of aliases (slot -1), which have two parts."""
    out = []
    for alias, x in [(False, name), *((True, a) for a in aliases or [])]:
        w = words_of(x)
        if w and (alias or kind == "person"):
            out += [(-1 if alias else len(w), place, part) for place, part in enumerate([w[0], " ".join(w[1:])] if alias else w)]
    return out


def places_of(words: list[str]) -> list[list[tuple[int, int, str]]]:
    """The places a name is looked up at: it is usual if all of one list are known."""
    out = [[(len(words), i, w) for i, w in enumerate(words)]]
    if len(words) > 1:
        out.append([(-1, 0, words[0]), (-1, 1, " ".join(words[1:]))])
    return out


def slip(words: list[str], candidates: list[tuple[float, int, str, bool, int]]) -> set[int]:
    """Members a misspelt form is meant for: no word of it may be another word.
    candidates: cosine, character_id, words, full, number of full variants."""
    text = _squeezed(words)
    full = sorted((c for c in candidates if c[3] and len(c[2].replace(" ", "")) > 5), key=lambda c: (-c[0], c[1], c[2]))
    best: dict[int, int] = {}
    least = allowed_edits(len(text))
    for _, i, variant, _, _ in full:
        v = variant.split()
        d = edit_distance(text, _squeezed(v), least)
        if d <= least:
            if len(v) == len(words) and any(another_word(a, b) for a, b in zip(words, v) if a != b):
                continue
            least = d
            best[i] = min(d, best.get(i, 99))
    near = {i for i, d in best.items() if d == least}
    if len(near) > 1:
        # average linkage: the mean cosine to all variants of a member, 0 under the threshold
        mean = dict.fromkeys(near, 0.0)
        for cos, i, _, _, n in full:
            if i in mean:
                mean[i] += cos / n
        most = max(mean.values())
        near = {i for i in near if mean[i] >= most - 1e-9}
    return near


def decided(tries: list[tuple[list[str], bool, list]]) -> set[int]:
    """The members a form means, of its tries (words, usual, candidates)."""
    for words, _, candidates in tries:
        got = {c[1] for c in candidates if c[2] == " ".join(words)}
        if got:
            return got
    for words, usual, candidates in tries:
        # parts written together, or one part cut off by a slip
        got = set() if usual else {c[1] for c in candidates if c[2].replace(" ", "") == _squeezed(words)}
        if got:
            return got
    for words, usual, candidates in tries:
        got = slip(words, candidates) if len(_squeezed(words)) > 4 and not usual else set()
        if got:
            return got
    return set()


# ---------------------------------------------------------- the join, broadcast


class Vectors:
    """The sparse matrix of all variants, by gram, for the product with a form."""

    def __init__(self, rows: list[tuple[int, str, bool]], usual: set[tuple[int, int, str]]):
        self.usual_parts = usual
        self.rows = sorted(rows)
        self.texts = sorted({_squeezed(w.split()) for _, w, _ in rows})
        place = {t: k for k, t in enumerate(self.texts)}
        owners: list[list[int]] = [[] for _ in self.texts]
        self.n_full: dict[int, int] = defaultdict(int)
        for r, (i, w, full) in enumerate(self.rows):
            text = _squeezed(w.split())
            owners[place[text]].append(r)
            self.n_full[i] += full and len(text) > 5
        self.owners = owners
        grams = [set(_grams(t)) for t in self.texts]
        df: dict[str, int] = defaultdict(int)
        for g in grams:
            for x in g:
                df[x] += 1
        n = len(self.texts)
        self.unknown = math.log(1 + n)
        self.idf = {x: math.log(1 + n / k) for x, k in df.items()}
        posting: dict[str, tuple[list[int], list[float]]] = defaultdict(lambda: ([], []))
        for t, g in enumerate(grams):
            norm = math.sqrt(sum(self.idf[x] ** 2 for x in g))
            for x in g:
                posting[x][0].append(t)
                posting[x][1].append(self.idf[x] / norm)
        self.posting = {x: (np.array(a, dtype=np.int64), np.array(w)) for x, (a, w) in posting.items()}

    def usual(self, words: list[str]) -> bool:
        return any(all(x in self.usual_parts for x in places) for places in places_of(words))

    def nearest(self, words: list[str]) -> list[tuple[float, int, str, bool, int]]:
        """Variants above the threshold of the TOP_N nearest members, ties included."""
        grams = set(_grams(_squeezed(words)))
        total = math.sqrt(sum(self.idf.get(x, self.unknown) ** 2 for x in grams))
        hit = [(*self.posting[x], self.idf[x] / total) for x in grams if x in self.posting]
        if not hit:
            return []
        cos = np.round(np.bincount(np.concatenate([a for a, _, _ in hit]), np.concatenate([w * v for _, w, v in hit]), minlength=len(self.texts)), 9)
        near = np.flatnonzero(cos >= MIN_COSINE)
        near = near[np.argsort(-cos[near], kind="stable")]
        taken: dict[int, float] = {}
        last = 2.0
        for t in near.tolist():
            if len(taken) >= TOP_N and cos[t] < last:
                break
            last = cos[t]
            for r in self.owners[t]:
                taken.setdefault(self.rows[r][0], last)
        return [(float(cos[t]), *self.rows[r], self.n_full[self.rows[r][0]]) for t in near.tolist() for r in self.owners[t] if self.rows[r][0] in taken]

    def link(self, form: str) -> set[int]:
        return decided([(w, self.usual(w), self.nearest(w)) for w in tries_of(form)])


def _linked(vectors):
    def run(batches):
        v = vectors.value
        for b in batches:
            forms, ids = [], []
            for form in b.column(0).to_pylist():
                for i in sorted(v.link(form)):
                    forms.append(form)
                    ids.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array(ids, pa.int64())], ["form", "character_id"])

    return run


# ---------------------------------------------------------- the join, by gram


def _each_member(make, columns: list[tuple[str, pa.DataType]]):
    def run(batches):
        for b in batches:
            rows = [x for i, name, kind, aliases in zip(*(b.column(k).to_pylist() for k in range(4))) for x in make(i, name, kind, [a for a in aliases or [] if a])]
            cols = list(zip(*rows)) or [[] for _ in columns]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, columns)], [n for n, _ in columns])

    return run


def variant_table(cast: DataFrame) -> DataFrame:
    """(character_id, words, full) of every member with a name."""
    rows = cast.filter("full_name is not null and character_id is not null").select("character_id", "full_name", "member_type", "aliases")
    return rows.mapInArrow(_each_member(member_variants, [("character_id", pa.int64()), ("words", pa.string()), ("full", pa.bool_())]), "character_id long, words string, full boolean").distinct()


def usual_table(cast: DataFrame) -> DataFrame:
    """(slot, place, part), distinct."""
    rows = cast.filter("full_name is not null").select("character_id", "full_name", "member_type", "aliases")
    return rows.mapInArrow(_each_member(lambda i, name, kind, aliases: usual_parts(name, kind, aliases), [("slot", pa.int32()), ("place", pa.int32()), ("part", pa.string())]), "slot int, place int, part string").distinct()


def _tried(batches):
    for b in batches:
        rows = [(f, k, " ".join(w)) for f in b.column(0).to_pylist() for k, w in enumerate(tries_of(f))]
        cols = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string()))], ["form", "try", "words"])


def _squeeze(c):
    return F.replace(c, F.lit(" "), F.lit(""))


def gram_rows(texts: DataFrame) -> DataFrame:
    """(text, gram): the distinct bigrams and trigrams of distinct texts."""
    x = F.concat(F.lit("^"), F.col("text"), F.lit("$"))

    def of(n: int):
        return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - (n - 1), F.lit(1))), lambda i: F.substring(x, i, F.lit(n))), lambda g: F.length(g) == n)

    return texts.select("text", F.explode(F.array_distinct(F.concat(of(2), of(3)))).alias("gram"))


def _by_gram(tries: DataFrame, variants_: DataFrame, cast: DataFrame) -> DataFrame:
    """(form, character_id): both sides shuffled by gram."""
    v = cut(variants_.withColumn("text", _squeeze(F.col("words"))))
    texts = v.select("text").distinct()
    n = float(texts.count())
    grams = cut(gram_rows(texts))
    idf = grams.groupBy("gram").agg(F.log(1 + F.lit(n) / F.count("*")).alias("idf"))
    weighted = grams.join(idf, "gram")
    norms = weighted.groupBy("text").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    posted = weighted.join(norms, "text").select("gram", F.col("text").alias("variant"), (F.col("idf") / F.col("norm")).alias("w"))
    asked = tries.select(_squeeze(F.col("words")).alias("text")).distinct()
    fw = gram_rows(asked).join(idf, "gram", "left").withColumn("idf", F.coalesce("idf", F.lit(math.log(1 + n))))
    fn = fw.groupBy("text").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    fw = fw.join(fn, "text").select("gram", "text", (F.col("idf") / F.col("norm")).alias("q"))
    cos = fw.join(posted, "gram").groupBy("text", "variant").agg(F.round(F.sum(F.col("q") * F.col("w")), 9).alias("cos")).filter(F.col("cos") >= MIN_COSINE)
    n_full = v.filter("full and length(text) > 5").groupBy("character_id").agg(F.count("*").alias("n_full"))
    rows = v.join(n_full, "character_id", "left").select("character_id", "words", "full", F.coalesce("n_full", F.lit(0)).cast("long").alias("n_full"), F.col("text").alias("variant"))
    near = cos.join(rows, "variant")
    best = near.groupBy("text", "character_id").agg(F.max("cos").alias("best"))
    kept = best.withColumn("r", F.rank().over(Window.partitionBy("text").orderBy(F.desc("best")))).filter(F.col("r") <= TOP_N).select("text", "character_id")
    # a form has its TOP_N members, the variants of a member are as many as its aliases allow
    listed = near.join(kept, ["text", "character_id"]).groupBy("text").agg(F.collect_list(F.struct("cos", "character_id", "words", "full", "n_full")).alias("candidates"))
    t = tries.withColumn("text", _squeeze(F.col("words")))
    parts = F.split("words", " ")
    here = F.transform(parts, lambda w, i: F.struct(F.lit(0).alias("kind"), F.size(parts).alias("slot"), i.alias("place"), w.alias("part")))
    split_ = F.array(*[F.struct(F.lit(1).alias("kind"), F.lit(-1).alias("slot"), F.lit(p).alias("place"), x.alias("part")) for p, x in ((0, parts[0]), (1, F.array_join(F.slice(parts, 2, 10_000), " ")))])
    looked = t.select("form", "try", F.explode(F.concat(here, F.when(F.size(parts) > 1, split_).otherwise(F.slice(split_, 1, 0)))).alias("x")).select("form", "try", "x.*")
    known = looked.join(usual_table(cast).withColumn("known", F.lit(True)), ["slot", "place", "part"], "left")
    usual = known.groupBy("form", "try", "kind").agg(F.every(F.coalesce("known", F.lit(False))).alias("u")).groupBy("form", "try").agg(F.max("u").alias("usual"))
    every = t.join(usual, ["form", "try"], "left").join(listed, "text").groupBy("form").agg(F.sort_array(F.collect_list(F.struct("try", "words", F.coalesce("usual", F.lit(False)).alias("usual"), "candidates"))).alias("tries"))

    def run(batches):
        for b in batches:
            out = [(f, i) for f, ts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i in sorted(decided([(x["words"].split(), x["usual"], [tuple(c.values()) for c in x["candidates"]]) for x in ts]))]
            cols = list(zip(*out)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())], ["form", "character_id"])

    return every.mapInArrow(run, "form string, character_id long")


# ---------------------------------------------------------- links and clusters


def mentions(graphs: DataFrame, stories: DataFrame, chunks: DataFrame) -> DataFrame:
    """(src, row_id, form) of all names in the three tables."""
    g = graphs.select(F.lit("document_graphs").alias("src"), F.col("graph_id").alias("row_id"), F.explode("entities.name").alias("form"))
    s = stories.select(F.lit("stories").alias("src"), F.col("story_row_id").alias("row_id"), F.explode("characters").alias("form"))
    c = chunks.select(F.lit("chunk_metadata").alias("src"), F.col("chunk_row_id").alias("row_id"), F.explode("characters").alias("form"))
    return g.unionByName(s).unionByName(c).filter("form is not null and trim(form) <> ''")


def link_forms(forms: DataFrame, cast: DataFrame, small: int = SMALL) -> DataFrame:
    """(form, character_id) of the distinct forms that mean a member."""
    distinct = forms.select("form").distinct()
    table = cut(variant_table(cast))
    rows = table.limit(small + 1).collect()  # at most small + 1 rows
    if len(rows) > small:
        tries = cut(distinct.mapInArrow(_tried, "form string, try int, words string"))
        return _by_gram(tries, table, cast)
    usual = {tuple(r) for r in usual_table(cast).collect()}  # parts of the names whose variants are counted above
    vectors = forms.sparkSession.sparkContext.broadcast(Vectors([tuple(r) for r in rows], usual))
    return distinct.mapInArrow(_linked(vectors), "form string, character_id long")


def variant_links(named: DataFrame, cast: DataFrame) -> DataFrame:
    """(src, row_id, character_id) of the rows that name a member by a form that is
    not exactly its full name."""
    other = named.join(small_side(cast.select(F.col("full_name").alias("form")).distinct()), "form", "left_anti")
    return other.join(link_forms(other, cast), "form").select("src", "row_id", "character_id").distinct()


def similar_forms(texts: DataFrame, least: float = MEET) -> DataFrame:
    """(a, b, s), a < b: pairs of distinct texts (text) whose cosine is at least so much.
    Only texts that share a gram of both prefixes meet: of the grams in order of their
    rarity, those after which the rest of the vector is shorter than the threshold."""
    grams = cut(gram_rows(texts))
    n = float(max(texts.count(), 1))
    idf = grams.groupBy("gram").agg(F.log(1 + F.lit(n) / F.count("*")).alias("idf"))
    v = grams.join(idf, "gram").groupBy("text").agg(F.sort_array(F.collect_list(F.struct("idf", "gram"))).alias("g"))
    total = F.aggregate("g", F.lit(0.0), lambda a, x: a + x["idf"] * x["idf"])
    v = cut(v.select("text", "g", F.sqrt(total).alias("norm")))
    # squares summed from the most usual gram on; the prefix is what lies at or above the bound
    below = F.transform("g", lambda x, i: F.aggregate(F.slice("g", F.lit(1), i + 1), F.lit(0.0), lambda a, y: a + y["idf"] * y["idf"]))
    kept = F.filter(F.transform(F.arrays_zip(F.col("g").alias("g"), below.alias("upto")), lambda z: F.when(z["upto"] >= (least * F.col("norm")) ** 2 - 1e-9, z["g"]["gram"])), lambda x: x.isNotNull())
    prefix = v.select("text", F.explode(kept).alias("gram"))
    met = prefix.withColumnRenamed("text", "a").join(prefix.withColumnRenamed("text", "b"), "gram").filter("a < b").select("a", "b").distinct()
    weights = F.map_from_entries(F.transform("g", lambda x: F.struct(x["gram"], x["idf"])))
    va, vb = (v.select(F.col("text").alias(x), weights.alias(f"w{x}"), F.col("norm").alias(f"n{x}")) for x in "ab")
    both = met.join(va, "a").join(vb, "b")
    shared = F.aggregate(F.map_entries("wa"), F.lit(0.0), lambda t, e: t + F.when(F.element_at("wb", e["key"]).isNotNull(), e["value"] * e["value"]).otherwise(0.0))
    return both.select("a", "b", F.round(shared / (F.col("na") * F.col("nb")), 9).alias("s")).filter(F.col("s") >= least)


def average_linkage(pairs: DataFrame, least: float = LINKAGE) -> DataFrame:
    """(node, cluster) of the nodes of pairs (a, b, s): agglomerative clusters by the mean
    similarity of all pairs of members, missing pairs counting 0, down to a mean of
    least; a cluster is named by its least node. In each round all pairs of clusters
    merge that are nearest to each other, in the order of (mean, names), which is total,
    so that a round without a merge is the end."""
    now = cut(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "s"))
    nodes = cut(now.select(F.col("u").alias("node")).union(now.select("v")).distinct().withColumn("cluster", F.col("node")))
    while True:
        sizes = nodes.groupBy("cluster").agg(F.count("*").alias("k"))
        su, sv = (sizes.select(F.col("cluster").alias(x), F.col("k").alias(f"k{x}")) for x in "uv")
        scored = now.join(su, "u").join(sv, "v").withColumn("mean", F.round(F.col("s") / (F.col("ku") * F.col("kv")), 9)).filter(F.col("mean") >= least)
        edge = F.struct((-F.col("mean")).alias("m"), "u", "v")
        best = scored.select(F.col("u").alias("c"), edge.alias("e")).unionAll(scored.select("v", edge)).groupBy("c").agg(F.min("e").alias("e"))
        merged = cut(best.groupBy("e.u", "e.v").agg(F.count("*").alias("n")).filter("n = 2").select("u", "v"))
        if merged.isEmpty():
            return nodes
        to = merged.select(F.col("v").alias("old"), F.col("u").alias("new"))
        nodes = cut(nodes.join(to, nodes.cluster == to.old, "left").select("node", F.coalesce("new", "cluster").alias("cluster")))
        x = now.join(to, now.u == to.old, "left").select(F.coalesce("new", "u").alias("u"), "v", "s")
        x = x.join(to, x.v == to.old, "left").select("u", F.coalesce("new", "v").alias("v"), "s").filter("u <> v")
        now = cut(x.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("s").alias("s")))


def clusters(forms: DataFrame, cast: DataFrame) -> DataFrame:
    """(form, cluster, character_id): every distinct form in the cluster of each member
    it means, or else, with a null character_id, in that of its like."""
    distinct = cut(forms.select("form").distinct())
    linked = cut(link_forms(distinct, cast))
    rest = distinct.join(linked, "form", "left_anti")
    text = cut(rest.mapInArrow(_tried, "form string, try int, words string").groupBy("form").agg(F.max_by("words", "try").alias("words")).select("form", _squeeze(F.col("words")).alias("text")))
    grouped = average_linkage(similar_forms(text.select("text").distinct()))
    named = text.join(grouped.withColumnRenamed("node", "text"), "text", "left").select("form", F.coalesce("cluster", "text").alias("cluster"))
    own = rest.join(named, "form", "left").select("form", F.coalesce("cluster", "form").alias("cluster"), F.lit(None).cast("long").alias("character_id"))
    return linked.select("form", F.concat(F.lit("member:"), F.col("character_id").cast("string")).alias("cluster"), "character_id").unionByName(own)
