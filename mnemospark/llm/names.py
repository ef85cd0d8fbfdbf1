"""Variant spellings of names: a prefix-filtered set-similarity join on token q-grams, verified by soft weighted token similarity.

Every name is brought to its skeleton, stripped of titles, legal forms and accents, and split into a core (the rare tokens:
surname or proper word) and qualifiers (the common ones: given name, branch and region words, kind of place). Which tokens
are common, and with which kind of entity they go, is counted over all names (lexicon()); the lists below are hints beside
that, for small tables. Cores, equal ones and those that differ by slips of typing, meet only in the join of their q-gram
sets on prefixes of the rarest q-grams. What meets is verified by soft weighted token similarity over all tokens of both
names: the share of the token weight that is matched, a token's weight being the logarithm of its rarity; initials and
short forms match in part, a token that only one name has counts QUIET of its weight, one that contradicts counts whole.
Only pairs of a name and a full name that reach MIN_SCORE are links. A bare core or an initial joins the one full name it
fits; where several fit it is left alone.
"""

from __future__ import annotations

import re
import unicodedata as u
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.components import components
from mnemospark.llm.pii import FEMALE, MALE, NICKNAMES
from mnemospark.llm.skeleton import skeleton_text
from mnemospark.session import cut

#: q-grams by length of the core: q -> (shortest, longest). Cores whose lengths differ by two still have one q in common.
GRAMS, MIN_SCORE, BARE_SCORE, BUCKET = {3: (1, 13), 4: (12, 1_000_000)}, 0.8, 0.85, 4_000
#: Weight of a token that the other name does not have, what an initial matches of a token, greatest weight of a token, and what makes a token common: least share of the entities, least number of them and of other tokens beside it, most tokens held.
QUIET, INITIAL, TOP_WEIGHT, COMMON, COMMON_LEAST, LEXICON = 0.15, 0.8, 9.0, 1 / 1000, 10, 50_000

# Fixed values.
BRANCH = "analytics brewing catering construction consulting dynamics electronics energy engineering foods freight insurance laboratories logistics manufacturing media optics pharma services shipping software steel systems technologies textiles trading".split()
REGION = "alpine atlantic central eastern general global harbour international maritime national northern pacific royal southern twin united western".split()
PLACE = "bridge hall lake park station valley airport avenue harbour market museum river square street tower".split()
LEGAL = re.compile(r"\b(?:s\.? ?a\.?|g\.?m\.?b\.?h\.?|inc\.?|incorporated|ltd\.?|limited|llc|plc|co\.?|company|corp\.?|corporation|grp\.?|group|sociedad ano?nima|aktiengesellschaft|a\.g\.|holdings?)(?![\w])")
TITLES = set("dr prof mr mrs ms miss eng sir herr frau don sra sr mx".split())
IDLE = set("the people area of and de la project proj team".split())


def _fold(s: str) -> str:
    s = "".join(c for c in u.normalize("NFD", s.casefold()) if not u.combining(c))
    return s.translate({0x142: "l", 0xF8: "o", 0xDF: "ss", 0x111: "d", 0xE6: "ae", 0x153: "oe", 0x131: "i"})


_GIVEN = {_fold(n): _fold(n) for n in [*FEMALE, *MALE]} | {_fold(a): _fold(b) for a, b in NICKNAMES.items()}


@lru_cache(maxsize=200_000)
def distance(a: str, b: str, most: int = 3) -> int:
    """Edit distance with transpositions; most + 1 where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


@lru_cache(maxsize=400_000)
def _mask(w: str) -> int:
    m = 0
    for c in w:
        m |= 1 << (ord(c) % 61)
    return m


def _close(a: str, b: str, most: int) -> bool:
    """distance(a, b) <= most, after two filters that cost little: lengths, and the sets of letters."""
    return abs(len(a) - len(b)) <= most and (_mask(a) ^ _mask(b)).bit_count() <= 2 * most and distance(a, b, most) <= most


def _subsequence(a: str, w: str) -> bool:
    it = iter(w)
    return a[0] == w[0] and all(c in it for c in a)


class Lexicon:
    """Common tokens: given names (token -> full form), words of organisations, words of places; weights of tokens."""

    def __init__(self, given: dict[str, str], words: list[str], places: list[str], hints: bool = True):
        self.given = {**({g: g for g in given} if not hints else _GIVEN | {g: _GIVEN.get(g, g) for g in given})}
        self.places = sorted({*places, *(PLACE if hints else ())})
        held = {*words, *([*BRANCH, *REGION] if hints else ())} - set(self.places) - set(self.given)
        brief = lambda t: len(t) <= 7 and any(len(w) > len(t) + 1 and (w.startswith(t) or _subsequence(t, w) and sum(c in "aeiou" for c in t) <= 1) for w in held)
        self.words = sorted(t for t in held if t in BRANCH or t in REGION or not brief(t))  # an abbreviation is no word of its own
        self._g: dict[str, str | None] = {}
        self._w: dict[tuple[str, bool], str | None] = {}

    def given_of(self, t: str) -> str | None:
        """The full given name a token stands for: itself, a short form, or one slip of typing away."""
        if t not in self._g:
            self._g[t] = self._given(t)
        return self._g[t]

    def _given(self, t: str) -> str | None:
        if t in self.given:
            return self.given[t]
        if len(t) < 5:  # short words are too near to each other
            return None
        near = {self.given[g] for g in self.given if len(g) >= 4 and _close(t, g, 1)}
        if not near and len(t) >= 6:
            near = {self.given[g] for g in self.given if len(g) >= 6 and g[0] == t[0] and _close(t, g, 2)}
        return min(near) if near else None

    def word_of(self, t: str, dotted: bool) -> str | None:
        """The common word a token stands for: itself, an abbreviation, or a slip of typing away."""
        if (t, dotted) not in self._w:
            self._w[t, dotted] = self._word(t, dotted)
        return self._w[t, dotted]

    def _word(self, t: str, dotted: bool) -> str | None:
        if t in self.words or t in self.places:
            return t
        if len(t) >= 2:
            if dotted or len(t) <= 7:
                pre = [w for w in self.words if w.startswith(t) and len(t) >= (3 if dotted else 4)]
                if len(pre) == 1:
                    return pre[0]
                sub = [w for w in self.words if len(w) > len(t) and _subsequence(t, w) and sum(c in "aeiou" for c in t) <= 1 + (t[-1] == "s")]
                if sub and len(t) >= 3:
                    return min(sub, key=lambda w: (len(w), w))
            if len(t) >= 4:
                near = [w for w in [*self.words, *self.places] if _close(t, w, 1 if len(w) < 7 else 2)]
                if near:
                    return min(near, key=lambda w: (distance(t, w, 2), w))
        return None


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, n, k in zip(b["id"], b["name"], b["kind"]):
            found = {x for x in re.findall(r"[^\W\d_]{2,}", LEGAL.sub(" ", _fold(skeleton_text(n)))) if x not in TITLES and x not in IDLE}
            kind = KINDS.get((k or "").strip().casefold(), "")
            rows += [(x, i, kind, min(found - {x}, default="")) for x in found]
        yield pd.DataFrame(rows, columns=["token", "id", "kind", "beside"])


def lexicon(names: DataFrame, entities: int, hints: bool = True) -> Lexicon:
    """The common tokens of all names (id, name, kind), each under the kind most of its entities have. At most LEXICON are held."""
    t = names.mapInPandas(_tokens, "token string, id string, kind string, beside string")
    by = F.count_distinct
    c = t.groupBy("token").agg(by("id").alias("n"), F.approx_count_distinct("beside").alias("besides"), *[by(F.when(F.col("kind") == k, F.col("id"))).alias(k) for k in ("person", "org", "place")])
    c = c.where((F.col("n") >= max(COMMON_LEAST, COMMON * entities)) & (F.col("besides") * 2 >= F.col("n") * 0.6)).orderBy(F.desc("n"), "token").limit(LEXICON)
    top: dict[str, list[str]] = {"person": [], "org": [], "place": []}
    for r in c.collect():
        k = max(top, key=lambda k: r[k])  # noqa: B023
        if r[k]:
            top[k].append(r["token"])
    return Lexicon(dict.fromkeys(top["person"], ""), top["org"], top["place"], hints)


def parse(name: str, lex: Lexicon | None = None) -> tuple[str, str | None, tuple[str, ...], str, str]:
    """(core, given, words, initials, shape) of a name; shape: person, org, place, project or '' where the name does not tell."""
    lex = lex or _HINTS
    s = _fold(skeleton_text(name))
    project = bool(re.search(r"\b(?:project|proj)\b", s))
    org = False
    t = LEGAL.sub(" ", s)
    if t != s:
        org = True
    raw = re.findall(r"[^\W_]+(?:['-][^\W_]+)*\.?", t)
    core, given, words, initials, skipped = [], None, [], "", []
    full = [x.rstrip(".").replace("'", "") for x in raw]
    for k, (x, y) in enumerate(zip(full, raw)):
        if not x or x in IDLE or (x in TITLES and (k == 0 or y.endswith(".")) and len(full) > 1 and not (x == "eng" and k > 0)):
            if x in ("people", "area") :
                skipped.append(x)
            continue
        if len(x) == 1:
            initials += x
            continue
        if (g := lex.given.get(x)) and given is None and not org:
            given = g
        elif len(full) > 1 and (w := lex.word_of(x, y.endswith("."))) and not project:
            words.append(w)
        else:
            core.append(x)
    if org and given is None and len(core) > 1 and not words:  # a proper word, and words that are not common enough to be known
        core, words = core[:1], core[1:]
    if given is None and len(core) > 1 and not words and not project:
        for k, x in enumerate(core):
            if g := lex.given_of(x):
                given = g
                del core[k]
                break
    if len(core) > 1 and words:  # a misspelt branch or region word beside the proper word
        core = core[:1] if not given else core
    if not core and words:
        core, words = [words[0]], words[1:]
    if not core and given and not words:
        return "", given, (), initials, "person"
    key = " ".join(sorted(core))
    places = [w for w in words if w in lex.places and w not in lex.words]
    shape = "project" if project else "person" if given else "place" if places and all(w in lex.places for w in words) else "org" if org or words else ""
    if shape == "" and initials:
        shape = "person" if len(initials) == 1 else "org"
    return key, given, tuple(sorted(set(words))), "".join(sorted(initials)) if shape == "org" else initials, shape


_HINTS = Lexicon({}, [], [])

# How kinds are spelt.
KINDS = {"person": "person", "people": "person", "organization": "org", "organisation": "org", "company": "org", "org": "org", "place": "place", "location": "place", "project": "project", "product": "project"}


def _parser(lex: Lexicon):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, n, k in zip(b["id"], b["name"], b["kind"]):
                core, given, words, initials, shape = parse(n, lex)
                if core:
                    rows.append((i, core, given, " ".join(words), initials, shape or KINDS.get((k or "").strip().casefold(), "")))
            yield pd.DataFrame(rows, columns=["id", "core", "given", "words", "initials", "shape"])

    return run


def _sets(w: str) -> tuple[int, int]:
    """The letters of a word, each with its how manieth, and its neighbouring letters, as bits: a slip changes at most two and six of them."""
    letters = couples = 0
    for i, c in enumerate(w):
        letters |= 1 << ((ord(c) + 29 * w.count(c, 0, i)) % 61)
    for a, b in zip(w, w[1:]):
        couples |= 1 << ((31 * ord(a) + ord(b)) % 61)
    return letters, couples


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for c in b["core"]:
            p, sets = f"##{c}$$", _sets(c)
            slips = 2 if len(c) >= 8 else 1
            for q, (least, most) in GRAMS.items():
                if least <= len(c) <= most:
                    keep = slips * (q + 1) + 1  # a slip breaks at most q + 1 grams (two letters exchanged)
                    grams = {p[i : i + q] for i in range(len(p) - q + 1)}
                    rows += [(c, q, x, keep, len(grams), *sets) for x in grams]
        yield pd.DataFrame(rows, columns=["core", "q", "gram", "keep", "held", "letters", "couples"])


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        d = [distance(x, y, 2) if _close(x, y, 2) else 3 for x, y in zip(b["a"], b["b"])]
        b = b.assign(edits=d)
        least = b["a"].str.len().combine(b["b"].str.len(), min)
        yield b[(b["edits"] == 0) | (b["edits"] == 1) & (least >= 5) | (b["edits"] == 2) & (least >= 8)][["a", "b", "edits"]]


def _spelt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b[np.array([_close(x, y, 1 if min(len(x), len(y)) < 6 else 2 if min(len(x), len(y)) < 8 else 3) for x, y in zip(b["a"], b["b"])], bool)]


def _posted(post: DataFrame) -> DataFrame:
    """(key, core, letters, couples, len): the couples, and where needed the single ones, of the q-grams of each core that others have as well."""
    g = F.array_sort("g")
    couples = F.flatten(F.transform(g, lambda x, i: F.transform(F.slice(g, i + 2, F.size(g)), lambda y: F.xxhash64(x["gram"], y["gram"]))))
    single = F.transform(F.filter(g, lambda x: (F.col("held") <= F.col("keep")) & (x["rk"] <= F.col("keep"))), lambda x: F.xxhash64(x["gram"]))
    by = post.where("n > 1").groupBy("core", "q", "keep", "held", "letters", "couples").agg(F.collect_list(F.struct("rk", "gram")).alias("g"))
    return by.select(F.explode(F.concat(couples, single)).alias("key"), "core", "letters", "couples", F.length("core").alias("len"))


def similar_cores(cores: DataFrame) -> DataFrame:
    """(a, b, edits), a <= b: equal cores, and cores within one slip of typing (two from eight letters on).

    Set-similarity join: q-grams are ordered from the rarest. The slips allowed break at most keep - 1 of them, so of the first
    keep of either core one stands in the other, and of the first keep + 1 two: no pair is missed. Cores are posted under
    all couples of their first keep + 1, which few others share; those of at most keep q-grams, that may have but one in common, under
    single ones as well. Lengths and sets of letters filter in the join, the edit distance once a pair after it;
    a core is posted with itself at its rarest q-gram alone. Adaptive execution splits hot couples.
    """
    g = cores.select("core").distinct().mapInPandas(_grams, "core string, q int, gram string, keep int, held int, letters long, couples long")
    g = cut(g)
    freq = g.groupBy("gram").agg(F.count("*").alias("n"))
    w = Window.partitionBy("core", "q").orderBy("n", "gram")
    post = g.join(freq, "gram").withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= F.col("keep") + 1).where("n > 1 or rk = 1")
    post = cut(post.select("gram", "core", "q", "rk", "n", "keep", "held", "letters", "couples"))
    a, b = _posted(post).alias("a"), _posted(post).alias("b")
    slips = F.when(F.least("a.len", "b.len") < 8, 1).otherwise(2)
    other = lambda c: F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}")))
    near = (F.col("a.key") == F.col("b.key")) & (F.abs(F.col("a.len") - F.col("b.len")) <= slips) & (other("letters") <= 2 * slips) & (other("couples") <= 6 * slips) & (F.col("a.core") < F.col("b.core"))
    pairs = a.join(b, near).select(F.col("a.core").alias("a"), F.col("b.core").alias("b")).distinct()
    itself = post.where("rk = 1").select(F.col("core").alias("a"), F.col("core").alias("b")).distinct()
    return pairs.unionByName(itself).mapInPandas(_near, "a string, b string, edits int")


def _bucket(df: pd.DataFrame) -> pd.DataFrame:
    """Distinct profiles of the cores of a bucket -> the class of each."""
    by: dict[str, list[tuple]] = {}
    for c, *rest in zip(*(df[k] for k in _PROFILE)):
        by.setdefault(c, []).append(tuple(rest))
    out = [(c, *r, label) for c, rs in by.items() for r, label in zip(rs, _classes(rs))]
    return pd.DataFrame(out, columns=[*_PROFILE, "label"])


def _classes(profiles: list[tuple]) -> list[str | None]:
    """The distinct profiles (given, words, initials, shape) of one core -> the class of each: the full form it belongs to."""
    rows = [(g or None, frozenset((w or "").split()), i or "", s or "") for g, w, i, s in profiles]
    known = sorted({x for _, w, _, _ in rows for x in w})
    longer = {x: [y for y in known if y != x and y.startswith(x)] for x in known if 2 < len(x) <= 5}
    rows = [(g, frozenset(longer[x][0] if len(longer.get(x, [])) == 1 else x for x in w), i, s) for g, w, i, s in rows]  # a word beside its abbreviation
    full: set[tuple] = set()
    sets: dict[str, set[frozenset]] = {}
    for g, w, i, s in rows:
        if g:
            full.add(("person", g))
        elif w:
            sets.setdefault("place" if s == "place" else "org", set()).add(w)
        elif s == "project":
            full.add(("project", ""))
    for s, ws in sets.items():
        for w in ws:
            if not any(w < o for o in ws):
                full.add((s, " ".join(sorted(w))))
    out = []
    for g, w, i, s in rows:
        if g:
            fit = {("person", g)}
        elif w:
            kind = "place" if s == "place" else "org"
            fit = {c for c in full if c[0] == kind and w <= frozenset(c[1].split())}
        elif i and s != "org":
            fit = {c for c in full if c[0] == "person" and c[1][:1] == i[:1]}
            if not fit:
                fit = {("person", i[:1] + ".")} if not any(c[0] == "person" for c in full) else set()
        elif i:
            fit = {c for c in full if c[0] == "org" and "".join(sorted(x[0] for x in c[1].split())) == i}
        elif s == "project":
            fit = {("project", "")}
        else:
            fit = {c for c in full if not s or c[0] == s}
        if not full and not fit:
            fit = {(s or "any", "")}
        out.append("|".join(next(iter(fit))) if len(fit) == 1 else None)
    return out


_PROFILE = ["core", "given", "words", "initials", "shape"]


def link(entities: DataFrame, aliases: DataFrame, hints: bool = True, least: float = MIN_SCORE) -> DataFrame:
    """(id, group_id): the unmerged entities whose names stand for the same thing.

    entities: id, canonical_name, kind, merged_into_id, several rows per id allowed; an id counts if merged_into_id is null in
    all its rows. aliases: entity_id, surface_text. hints: whether the lists help; least: the least score of a link. Null names are skipped; names without a letter stand for nothing.
    """
    open_ = entities.where("id is not null").groupBy("id").agg(F.max(F.col("merged_into_id").isNotNull()).alias("merged"), F.min("kind").alias("kind")).where("not merged").select("id", "kind")
    names = entities.select("id", F.col("canonical_name").alias("name")).unionByName(aliases.select(F.col("entity_id").alias("id"), F.col("surface_text").alias("name")))
    names = names.where("name is not null").distinct().join(open_, "id")
    names = cut(names)
    total = open_.count()
    lex = lexicon(names, total, hints)
    p = cut(names.mapInPandas(_parser(lex), "id string, core string, given string, words string, initials string, shape string").distinct())
    near = cut(similar_cores(p))

    # Spellings of one core that one entity carries side by side are the same core: each is held against the entity's main one.
    mine = p.groupBy("id", "core").agg(F.count("*").alias("n"))
    main = mine.groupBy("id").agg(F.min(F.struct(-F.col("n"), "core")).alias("m")).select("id", F.col("m.core").alias("a"))
    same = mine.join(main, "id").where("core <> a").select("a", F.col("core").alias("b")).distinct().mapInPandas(_spelt, "a string, b string")
    spelt = components(same, "a", "b")
    p = cut(p.join(spelt.select(F.col("id").alias("core"), "group_id"), "core", "left").withColumn("core", F.coalesce("group_id", "core")).drop("group_id").distinct())

    # What one entity's names say together: a bare form beside a full one adds nothing.
    full = (F.col("given").isNotNull()) | (F.col("words") != "") | (F.col("shape") == "project")
    has = p.groupBy("id", "core").agg(F.max(full).alias("has_full"), F.max(F.when(F.col("initials") != "", True).otherwise(False)).alias("has_initial"))
    p = p.join(has, ["id", "core"]).where(full | ~F.col("has_full") & ((F.col("initials") != "") | ~F.col("has_initial"))).drop("has_full", "has_initial")
    p = cut(p.fillna("", ["given", "words", "initials", "shape"]).distinct())
    profiles = p.select(*_PROFILE).distinct()
    buckets = max(1, profiles.count() // BUCKET)
    profiles = profiles.withColumn("bucket", F.pmod(F.xxhash64("core"), F.lit(buckets)).cast("int")).repartition(buckets, "bucket")
    labels = profiles.groupBy("bucket").applyInPandas(_bucket, "core string, given string, words string, initials string, shape string, label string")
    member = p.join(labels, _PROFILE).where("label is not null")

    # Verification: every name against the full name it belongs to, over all tokens of both. Their cores have met in the join.
    n = F.lit(float(total + 1))
    rare = lambda c: F.least(F.log(n / F.col(c)), F.lit(TOP_WEIGHT))
    cores = p.groupBy("core").agg(F.count_distinct("id").alias("c"))
    toks = p.select("id", F.explode(F.array_distinct(F.concat(F.split("words", " "), F.array("given")))).alias("tok")).where("tok <> ''").groupBy("tok").agg(F.count_distinct("id").alias("c"))
    m = member.select("id", "core", "given", "words", "initials", "label").distinct()
    pairs_ = m.select("core", "given", "words", "initials", "label").distinct()
    # tokens of the name and of the full name, with what of each is matched
    own = F.filter(F.concat(F.split("words", " "), F.array("given")), lambda x: x != "")
    whole = F.filter(F.split(F.element_at(F.split("label", "[|]"), 2), " "), lambda x: x != "")
    e = pairs_.withColumn("own", own).withColumn("whole", whole).withColumn("tok", F.explode_outer(F.array_union("own", "whole")))
    e = e.join(toks.withColumn("w", rare("c")).select("tok", "w"), "tok", "left")
    mine, theirs = F.array_contains("own", F.col("tok")), F.array_contains("whole", F.col("tok"))
    initial = F.col("initials").contains(F.substring("tok", 1, 1)) & (F.col("initials") != "")
    w = F.coalesce("w", F.when(F.col("tok").isNotNull(), F.lit(TOP_WEIGHT)).otherwise(F.lit(0.0)))
    hit = F.when(mine & theirs, w).when(theirs & initial, w * INITIAL).otherwise(F.lit(0.0))
    miss = F.when(mine & theirs, w).when(theirs & initial, w).when(theirs, w * QUIET).when(F.size("whole") == 0, w * QUIET).otherwise(w)
    v = e.groupBy("core", "given", "words", "initials", "label").agg(F.sum(hit).alias("hit"), F.sum(miss).alias("all"))
    met = near.where("edits = 0").select(F.col("a").alias("core"))
    v = v.join(met, "core").join(cores.withColumn("wc", rare("c")).select("core", "wc"), "core")
    v = v.withColumn("score", (F.col("wc") + F.col("hit")) / (F.col("wc") + F.col("all"))).where(F.col("score") >= least)
    member = cut(m.join(v.select("core", "given", "words", "initials", "label"), ["core", "given", "words", "initials", "label"]).select("id", F.concat_ws("|", "core", "label").alias("node"), "core", "label").distinct())

    # Slips of typing across entities: both cores, and the whole of what qualifies them, have to match.
    classes = member.groupBy("node", "core", "label").agg(F.count("*").alias("m"))
    weight = cut(member.groupBy("label").agg(F.log(n / F.count("*")).alias("w_label")))
    q = classes.where("label rlike '[|].' or label in ('place|', 'project|', 'org|')").join(weight, "label").withColumn("w_core", F.log(n / F.col("m")))
    x = q.select(F.col("core").alias("a"), "label", F.col("node").alias("na"), F.col("w_core").alias("wa"), "w_label")
    y = q.select(F.col("core").alias("b"), "label", F.col("node").alias("nb"), F.col("w_core").alias("wb"))
    sim = 1 - F.col("edits") / F.greatest(F.length("a"), F.length("b"))
    w = F.greatest("wa", "wb")
    strict = (F.col("label") != "org|") | (sim >= BARE_SCORE)  # a legal form says nothing about which organisation it is
    slips = near.where("edits > 0").join(x, "a").join(y, ["b", "label"]).where((w * sim + F.col("w_label")) / (w + F.col("w_label")) >= least).where(strict).select("na", "nb")
    edges = member.select(F.concat(F.lit("e|"), "id").alias("a"), F.concat(F.lit("n|"), "node").alias("b")).unionByName(slips.select(F.concat(F.lit("n|"), "na").alias("a"), F.concat(F.lit("n|"), "nb").alias("b")))
    g = components(edges)
    return g.where("id like 'e|%'").select(F.substring("id", 3, 1_000_000).alias("id"), "group_id")


def pairs(groups: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of a group, as the result asks for pairs of ids."""
    x, y = groups.alias("x"), groups.alias("y")
    return x.join(y, (F.col("x.group_id") == F.col("y.group_id")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
