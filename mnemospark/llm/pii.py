"""Personal information in free text: find it, and replace it with keyed surrogates inside typed placeholders.

Detection is by form: e-mail addresses (also written in words), telephone numbers, labelled identity numbers, street
addresses and names of persons. Names need no list: learn() counts over the whole table which capitalised words stand
first in pairs with many different second words and are never ordinary words; those are given names. Titles and words that
only go with persons are evidence in the single text, and the lists below are one hint among these, for small tables.

Surrogates keep type, script, gender, letter case and format. Every map used is one-to-one for a given key and leaves no
piece as it is (cyclic permutations of lists, of digits and of the letters of every script), so different originals keep
different surrogates and one original keeps its surrogate everywhere. A short form follows its full name, and the names in
the first part of an e-mail address follow the person's. collisions() is the check over a whole table.
"""

from __future__ import annotations

import hashlib
import hmac
import unicodedata as u
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Given names by the gender they usually go with.
FEMALE = """Adele Agnes Alice Amelia Angela Astrid Barbara Beatrice Bianca Camille Carla Caroline Catherine Clara Claudia
Cornelia Deborah Dorothy Edith Eleanor Elena Elizabeth Emma Esther Fiona Florence Frances Gemma Gertrude Gloria Hannah Helen
Ida Ines Ingrid Irene Jasmin Jennifer Judith Julia Katarina Laura Lillian Lydia Margaret Martha Melanie Miriam Monica Nadia
Nora Olga Pamela Patricia Paula Rachel Rebecca Rosalind Ruth Sandra Sigrid Sofía Stella Susan Sylvia""".split()
MALE = """Alberto Alexander Alfred Andrew Anselm Anthony Arthur Benjamin Bernard Bruno Charles Christopher Conrad Daniel
David Diego Dominic Edmund Edward Emil Erik Eugene Felix Frederick Gabriel George Gerald Gregory Gustav Harold Henry Hugo Ian
Ignatius Iván Jacob James Joachim Jonathan Joseph Karim Kenneth Kilian Lawrence Leonard Lucas Magnus Marcus Matthew Michael
Nathaniel Nicholas Oscar Peter Philip Raymond Richard Robert Roland Samuel Sebastian Simon Stephen Theodore Thomas Timothy""".split()
# Short forms of given names.
NICKNAMES = {
    "Alex": "Alexander", "Andy": "Andrew", "Barb": "Barbara", "Bas": "Sebastian", "Bea": "Beatrice", "Becky": "Rebecca", "Ben": "Benjamin", "Beth": "Elizabeth", "Bob": "Robert", "Charlie": "Charles", "Chris": "Christopher", "Chuck": "Charles", "Dan": "Daniel", "Dave": "David", "Debbie": "Deborah", "Dick": "Richard", "Dot": "Dorothy", "Ed": "Edward", "Ellie": "Eleanor", "Fran": "Frances", "Fred": "Frederick", "Gabe": "Gabriel", "Gene": "Eugene", "Gerry": "Gerald", "Greg": "Gregory", "Gus": "Gustav", "Hal": "Harold", "Hank": "Henry", "Harry": "Harold", "Jake": "Jacob", "Jen": "Jennifer", "Jenny": "Jennifer", "Jerry": "Gerald", "Jim": "James", "Joe": "Joseph", "Jon": "Jonathan", "Kate": "Catherine", "Kathy": "Catherine", "Kat": "Katarina", "Ken": "Kenneth", "Larry": "Lawrence", "Len": "Leonard", "Lily": "Lillian", "Liz": "Elizabeth", "Maggie": "Margaret", "Marty": "Martha", "Matt": "Matthew", "Mel": "Melanie", "Mike": "Michael", "Nell": "Eleanor", "Nate": "Nathaniel", "Nick": "Nicholas", "Pam": "Pamela", "Pat": "Patricia", "Peggy": "Margaret", "Pete": "Peter", "Phil": "Philip", "Ray": "Raymond", "Rick": "Richard", "Rob": "Robert", "Ros": "Rosalind", "Sam": "Samuel", "Seb": "Sebastian", "Steve": "Stephen", "Sue": "Susan", "Ted": "Theodore", "Theo": "Theodore", "Tim": "Timothy", "Tom": "Thomas", "Tony": "Anthony", "Trish": "Patricia",
}
# Lower-case words that may follow a given name standing alone, or stand before a comma and one.
WORDS = set("""a about above add after again all along also always an and any are as asked at audits be because been before books
booked but buys by calls can cancelled cc charges closes comes could delivers depends did dislikes do does drives during each
employs every exceeds finished for former from gets got grew had has have he heard held her here his how if in into is it its
joined joins keeps late last later learned leads likes lives makes may me mentors might more moved moves must my needs never
next no nobody not now of off offered on once one only or our out over owes owns painted picked plays prefers reads
rejected relocated remains renewed rents reserved rides runs said says settled shall she shares should since sit sits slipped so sold some
started stayed stays still stops stores takes terminated than that the their them then there these they this those through to
together told took too under until up uses usually via wants was we went were what when where which while who will with without would
wrote yesterday yet you your ist und et eur usd gbp chf euros dollars pounds noted record fyi again reminder""".split())

# Words that make the name of an organisation, a place or a project, and words of the calendar: no person has them.
OTHERS = set("""project proj group ltd inc gmbh company corp corporation holding holdings llc plc bank university institute school college hospital
museum hotel church airport station hall lake park valley bridge market square tower street road avenue lane river harbour hill island county city north south
east west northern southern eastern western central international national global royal general united pacific atlantic alpine maritime twin analytics brewing
catering construction consulting dynamics electronics energy engineering foods freight insurance laboratories labs logistics manufacturing media optics pharma
services shipping software solutions steel systems technologies textiles trading industries partners foundation association society club team office department
room flight order ticket part contract version january february march april may june july august september october november december monday tuesday wednesday
thursday friday saturday sunday english german french spanish italian welsh""".split())
# Lower-case words that a person's name follows, and that follow one.
BEFORE = set("call calls called contact ask asks asked tell told meet met with from cc dear hi hello thanks regards sincerely via by email phone ring visit thank colleague friend".split())
AFTER = set("""met called calls said says told asked wrote owes wants likes loves lives works worked joined moved plays drives reads prefers thinks knows speaks studied
married retired drinks eats sleeps sings dislikes mentors sent replied resigned agreed confirmed hopes""".split())
# The most usual Chinese and Korean family names, for names in these scripts.
FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严张陳劉楊黃趙吳孫馬鄭許鄧김이박최정강조윤장임한오서신권황안송류홍"
#: Words that a text is held against at most: the given names most often seen. A word has to be seen before this many different ones.
LEXICON, FOLLOWERS = 50_000, 3

_GIVEN = {u.normalize("NFC", n).casefold() for n in [*FEMALE, *MALE, *NICKNAMES]}
_ASCII_GIVEN = {"".join(c for c in u.normalize("NFD", n) if not u.combining(c)) for n in _GIVEN}
_W = r"\s+"
_EXT = r"(?:\s*(?:ext\.?|extension|x)\s*\d{1,5})?"

EMAIL = re.compile(
    r"""(?xi) (?<![\w.+@-])
    (?: [\w.+'-]*\w \s*@\s*? (?:[a-z0-9](?:[\w-]*\w)?\.)+[a-z]{2,}
      | [\w.+'-]*\w \s* (?:\[at\]|\(at\)|\{at\}) \s* [a-z0-9][\w-]* (?:\s*(?:\[dot\]|\(dot\)|\{dot\}|\bdot\b|\.)\s*[a-z][\w-]*)+
      | [\w.+'-]*\w \s+ at \s+ [a-z0-9][\w-]* (?:\s+dot\s+[a-z][\w-]*)+ )"""
)
PHONE = re.compile(
    rf"""(?xi) (?<![\w.+/-])(?<!\d\s)
    (?: \+1[\s.-]*\(?\d{{3}}\)?[\s.-]*\d{{3}}[\s.-]*\d{{4}}
      | \+44\s*(?:\(0\)\s*)?\d{{2,5}}\s*\d{{3,4}}\s*\d{{3,6}}
      | \+\d{{2,3}}(?:[\s.-]+\d{{2,4}}){{2,4}} | \+\d{{9,14}}
      | 00\d{{2}}\s+\d{{2,4}}(?:\s+\d{{3,6}}){{1,2}}
      | 1-\d{{3}}-\d{{3}}-\d{{4}}
      | \(\d{{3}}\)[\s./-]*\d{{3}}[\s.-]+\d{{4}}
      | \d{{3}}([./-])\d{{3}}[.-]\d{{4}}
      | 0\d{{2,4}}\s+\d{{3,4}}\s+\d{{3,4}}
      | 0\d(?:[\s.]\d{{2}}){{4}} | 0\d{{2,4}}/\d{{5,8}}
      | \d{{3}}-\d{{4}} ) (?![\w/-])(?!\.\d) {_EXT}"""
)
LABEL = r"(?:passport|ssn|dni|nif|nie|social\s+security|national\s+(?:id|identity|insurance)|driving\s+licen[cs]e|driver'?s?\s+licen[cs]e|identity|tax\s+id|taxpayer|id\s+card|identity\s+card|personal|insurance)(?:\s+(?:number|no\.?|id|card))*"
ID = re.compile(
    rf"""(?xi) \b{LABEL.replace(' ', '[ ]')} \s*[\])]?\s* (?:is\b|[:=\#])? \s*
    (?P<v> [a-z]{{1,2}}-\d{{3,4}}-\d{{3,4}}-\d{{1,2}} | [a-z]{{2}}\s+\d{{2}}\s+\d{{2}}\s+\d{{2}}\s+[a-z] | \d{{1,2}}\.\d{{3}}\.\d{{3}}-[\dkx]
      | \d{{3}}([\s-]+)\d{{2}}[\s-]+\d{{4}} | \d{{6}}-\d{{4}} | \d{{7,9}}-?[a-z] | [a-z]{{1,2}}\d{{6,8}}[a-z]? | \d{{7,12}} | [a-z]{{1,3}}-?\d{{5,10}} ) (?![\w-])"""
)
# A label with a slip of typing in it: "has" or "shown", one to three words, and a number in the form of an identity number.
ID_LOOSE = re.compile(r"""(?xi) \b(?:has|shown|the) \s+ (?!order|ticket|part|contract|purchase|version|build|room|flight|size|ratio|floor|phone|licen[cs]e\b)
    (?:[a-z]{2,12}\.?\s+){1,3}? (?:is\s+)? (?P<v> [a-z]{2}-\d{3,4}-\d{3,4}-\d | [a-z]{2}\s+\d{2}\s+\d{2}\s+\d{2}\s+[a-z] | \d{2}\.\d{3}\.\d{3}-[\dk] | \d{3}([\s-])\d{2}[\s-]\d{4} | \d{6}-\d{4} | \d{8}-?[a-z] | [a-z]\d{7}[a-z]? ) (?![\w-])""")
_POST = r"(?:\d{5}|[A-Z]{1,2}\d{1,2}[A-Z]?\s+\d[A-Z]{2})"
_CAP = r"\p{Lu}[\p{L}\p{M}'’-]+"
_SUFFIX = r"(?:Drive|Close|Lane|Road|Rd\b\.?|Street|St\b\.?|Avenue|Ave\b\.?|Court|Gardens|Row|Way|Place|Terrace|Crescent|Square|Grove|Walk|Mews|Hill|Boulevard|Blvd\b\.?)"


def _address(flags: str) -> re.Pattern:
    cap = r"[\p{L}][\p{L}\p{M}'’-]+" if flags else _CAP
    return re.compile(
        rf"""(?x{flags}) (?<![\w/-])
        (?: (?:(?:Apt|Flat|Unit|Suite)\.?\s+\d+[A-Za-z]?,\s*)? \d+\s?[A-Za-z]?\s+ (?:{cap}\s+){{1,3}}? {_SUFFIX} (?![\p{{L}}]) (?:\s*\#\s?\d+|,\s*(?:Flat|Apt|Unit|Suite)\.?\s+\d+[A-Za-z]?)? (?:,\s*{cap}(?:\s+{_POST})?)?
          | \d+\s?(?:bis|ter)?,?\s+(?:rue|avenue|boulevard|place|chemin|impasse|quai|allée|Rue|Avenue|Boulevard|Place|Chemin|Impasse|Quai|Allée)\s+(?:(?:des|de\s+la|de\s+l['’]|du|de|d['’])\s*)?{cap}(?:\s+{cap})?(?:,\s*{_POST}\s+{cap})?
          | (?: (?:Rue|C/|Calle|Via|Avenida|Plaza|Paseo|Am|Im|Viale|Piazza|Corso|Camino)\s+ (?:(?:des|de\s+la|del|de|di|della|du)\s+)? {cap} | \p{{L}}+(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|ufer) )
            \s+ (?:(?:nº|n\.º|n°|n\.|no\.|nr\.)\s*)? \d+\s?(?:[A-Za-z](?![\p{{L}}]))? (?:,\s*\d+\s?[ºª°]\s?[A-Z](?![\p{{L}}]))? (?:,\s*{_POST}\s+{cap})? )"""
    )


ADDRESS, ADDRESS_ANY = _address(""), _address("i")
_TOKEN = re.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*(?:-[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*)*")
_INITIAL = re.compile(r"\p{L}")
_TITLE = {"dr", "prof", "mr", "mrs", "ms", "miss", "sir", "eng", "herr", "frau", "don", "doña", "sr", "sra"}


def caseless(text: str) -> bool:
    """Letter case tells nothing in a text that is (nearly) all of one case."""
    up = sum(c.isupper() for c in text)
    low = sum(c.islower() for c in text)
    return up == 0 or up > 0.6 * (up + low)


def _bare(w: str) -> str:
    return re.sub(r"['’]s$", "", w, flags=re.I)


def _is_given(w: str, learnt: frozenset[str] = frozenset()) -> bool:
    w = u.normalize("NFC", _bare(w)).casefold()
    return w in _GIVEN or w in _ASCII_GIVEN or w in learnt


def _surname_like(w: str, free: bool) -> bool:
    """free: letter case tells nothing here."""
    b = _bare(w)
    if len(b) < 3 or not free and len(b) == 3 and b.isupper() or b.casefold() in WORDS or b.casefold() in _TITLE:
        return False
    return free or b[0].isupper()


def names(text: str, taken: list[tuple[int, int]], learnt: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """Spans of the names of persons outside the spans already taken."""
    toks = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
    free_text = caseless(text)
    out: list[tuple[int, int]] = []
    used = [False] * len(toks)
    for i, (s, e, _) in enumerate(toks):
        used[i] = any(s < b and a < e for a, b in taken)
    gap = lambda i, j: text[toks[i][1] : toks[j][0]]
    blank = lambda g: bool(re.fullmatch(r"\s+", g))
    comma = lambda g: bool(re.fullmatch(r",\s+", g))
    dot = lambda g: bool(re.fullmatch(r"\.?\s+", g))

    def close(i: int, j: int) -> tuple[int, int]:
        for k in range(i, j + 1):
            used[k] = True
        end = toks[i][0] + len(text[toks[i][0] : toks[j][0]]) + len(_bare(toks[j][2]))
        if len(toks[j][2]) == 1 and text[end : end + 1] == "." and i != j:
            end += 1
        return toks[i][0], end

    n = len(toks)
    for i in range(n):
        if used[i]:
            continue
        w = toks[i][2]
        if _is_given(w, learnt):
            free = free_text or not w[0].isupper()
            j = i
            owns = bool(re.search(r"['’]s$", w, flags=re.I))
            if owns:
                pass
            elif j + 2 < n and len(toks[j + 1][2]) == 1 and blank(gap(j, j + 1)) and dot(gap(j + 1, j + 2)) and not used[j + 1] and not used[j + 2] and "." in gap(j + 1, j + 2) and _surname_like(toks[j + 2][2], free):
                j += 2
            elif j + 1 < n and blank(gap(j, j + 1)) and not used[j + 1] and _surname_like(toks[j + 1][2], free):
                j += 1
            k = i
            if j == i and i and not used[i - 1] and _surname_like(toks[i - 1][2], free_text or toks[i - 1][2].islower()):
                before = toks[i - 1][2]
                if comma(gap(i - 1, i)) and (before[0].isupper() or (not w[0].isupper())) and not _is_given(before, learnt):
                    k = i - 1
                    if i + 1 < n and len(toks[i + 1][2]) == 1 and blank(gap(i, i + 1)) and text[toks[i + 1][1] : toks[i + 1][1] + 1] == ".":
                        j = i + 1
                elif blank(gap(i - 1, i)) and before.isupper() and len(before) > 3 and not free_text:
                    k = i - 1
            out.append(close(k, j))
        elif len(w) == 1 and i + 1 < n and not used[i + 1] and re.fullmatch(r"\.\s+", gap(i, i + 1)) and (not i or not re.fullmatch(r"\.", gap(i - 1, i))) and _surname_like(toks[i + 1][2], free_text or w.islower()) and not _is_given(toks[i + 1][2], learnt) and _initial_ok(text, toks, i):
            out.append(close(i, i + 1))
        elif i + 1 < n and len(toks[i + 1][2]) == 1 and not used[i + 1] and comma(gap(i, i + 1)) and text[toks[i + 1][1] : toks[i + 1][1] + 1] == "." and _surname_like(w, free_text or w.islower()) and len(w) > 4:
            s, e = close(i, i + 1)
            out.append((s, e))
    if not free_text:
        out += _by_evidence(text, toks, used)
    out += [m.span() for m in _HAN.finditer(text) if m[0][0] in FAMILY and not any(m.start() < b and a < m.end() for a, b in [*taken, *out])]
    return sorted(out)


_HAN = re.compile(r"(?<![\p{Han}\p{Hangul}])(?:\p{Han}{2,3}|\p{Hangul}{3})(?![\p{Han}\p{Hangul}])")
_TITLED = {"dr", "prof", "mr", "mrs", "ms", "miss", "sir", "herr", "frau", "señor", "señora"}


def _proper(w: str) -> bool:
    b = _bare(w).casefold()
    return w[0].isupper() and len(w) > 1 and not (w.isupper() and len(w) < 4) and b not in OTHERS and b not in WORDS and b not in _TITLE


def _runs(text: str, toks: list, used: list[bool]) -> Iterator[tuple[int, int]]:
    """Runs of capitalised words with nothing but blanks between them: (first, last)."""
    i, n = 0, len(toks)
    while i < n:
        j = i
        if toks[i][2][0].isupper() and not used[i]:
            while j + 1 < n and not used[j + 1] and toks[j + 1][2][0].isupper() and text[toks[j][1] : toks[j + 1][0]].isspace():
                j += 1
            yield i, j
        i = j + 1


def _by_evidence(text: str, toks: list, used: list[bool]) -> list[tuple[int, int]]:
    """Names that no word betrays: after a title, beside a word that goes with persons."""
    out = []
    for i, j in _runs(text, toks, used):
        words = [t[2] for t in toks[i : j + 1]]
        low = words[0].casefold()
        titled = low in _TITLED and len(words) > 1 or i > 0 and toks[i - 1][2].casefold() in _TITLED and re.fullmatch(r"\.?\s+", text[toks[i - 1][1] : toks[i][0]]) is not None
        cue = len(words) in (3, 4) and low in BEFORE
        k = i + (low in _TITLED or cue)
        body = toks[k : j + 1]
        before = toks[i - 1][2] if i and text[toks[i - 1][1] : toks[i][0]].isspace() else ""
        after = toks[j + 1][2] if j + 1 < len(toks) and text[toks[j][1] : toks[j + 1][0]].isspace() else ""
        if not 1 <= len(body) <= 3 or not all(_proper(t[2]) for t in body):
            continue
        if titled or len(body) >= 2 and (cue or before.islower() and before in BEFORE and after.casefold() not in OTHERS or after in AFTER):
            out.append((body[0][0], body[-1][0] + len(_bare(body[-1][2]))))
    return out


_JOINED = re.compile(r"[@._+-]\w")


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of every batch: pairs of capitalised words (word, other), and how often words stand in lower case (word, null)."""
    from collections import Counter

    for b in batches:
        pairs, low, second, mid = Counter(), Counter(), Counter(), Counter()
        for t in b["text"]:
            if not t or caseless(t):
                continue
            toks = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(t)]
            low.update(w.casefold() for _, _, w in toks if w.islower())
            for i, j in _runs(t, toks, [False] * len(toks)):
                if j == i + 1 and _proper(toks[i][2]) and _proper(toks[j][2]) and not _JOINED.match(t, toks[j][1]):
                    pairs[toks[i][2].casefold(), _bare(toks[j][2]).casefold()] += 1
                    second[_bare(toks[j][2]).casefold()] += 1
                    mid[toks[i][2].casefold()] += i > 0 and toks[i - 1][2].islower() and t[toks[i - 1][1] : toks[i][0]].isspace()
        rows = [(a, c, n, 0, 0, 0) for (a, c), n in pairs.items()] + [(a, None, 0, n, 0, 0) for a, n in low.items()] + [(a, None, 0, 0, n, mid[a]) for a, n in {**dict.fromkeys(mid, 0), **second}.items()]
        yield pd.DataFrame(rows, columns=["word", "other", "first", "low", "second", "mid"])


def learn(df: DataFrame, text_col: str) -> frozenset[str]:
    """Given names by what the whole table says: words that begin pairs with FOLLOWERS or more different second words, also
    within sentences, that end far fewer pairs, and that hardly ever stand in lower case. At most LEXICON words, those with the most second words, are kept;
    a name beyond that is still found by a title, a word beside it, an initial or the lists."""
    c = df.select(F.col(text_col).alias("text")).where("text is not null").mapInPandas(_counted, "word string, other string, first long, low long, second long, mid long")
    sums = [F.sum(x).alias(x) for x in ("first", "low", "second", "mid")]
    g = c.groupBy("word", "other").agg(*sums).groupBy("word").agg(F.count("other").alias("others"), *sums)
    g = g.where("mid > 0").where((F.col("others") >= FOLLOWERS) & (F.col("second") * 4 <= F.col("first")) & (F.col("low") * 5 <= F.col("first")))
    return frozenset(u.normalize("NFC", r[0]) for r in g.orderBy(F.desc("others"), "word").limit(LEXICON).select("word").collect())


def _initial_ok(text: str, toks: list, i: int) -> bool:
    """An initial with its dot that ends no other token and is not the tail of an abbreviation such as S.A."""
    s = toks[i][0]
    return s == 0 or text[s - 1] not in ".&/º" and not text[s - 1].isdigit()


_DIGIT = re.compile(r"\d")
_AT = re.compile(r"(?i)@|[\[({]at[\])}]|\sat\s")


def find(text: str | None, learnt: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """(start, end, type) of each piece, in order, without overlap; [] for null or empty text. learnt: given names from learn()."""
    if not text:
        return []
    got: list[tuple[int, int, str]] = []

    def add(s: int, e: int, kind: str) -> None:
        if not any(s < b and a < e for a, b, _ in got):
            got.append((s, e, kind))

    if _AT.search(text):
        for m in EMAIL.finditer(text):
            add(m.start(), m.end(), "email")
    if _DIGIT.search(text):
        for m in ID.finditer(text):
            add(*m.span("v"), "id_number")
        for m in ID_LOOSE.finditer(text):
            add(*m.span("v"), "id_number")
        for m in (ADDRESS_ANY if caseless(text) else ADDRESS).finditer(text):
            add(m.start(), m.end(), "address")
        for m in PHONE.finditer(text):
            add(m.start(), m.end(), "phone")
    for s, e in names(text, [(a, b) for a, b, _ in got], learnt):
        add(s, e, "name")
    return sorted(got)


# Surrogates


@lru_cache(maxsize=4_096)
def _alphabet(low: str) -> str:
    """The letters a letter may become: vowels or consonants of the plain alphabet, digits, else those of its kind in its part of its script."""
    for plain in ("aeiou", "bcdfghjklmnpqrstvwxyz", "0123456789", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ"):
        if low in plain:
            return plain
    kind, base = u.category(low), ord(low) & ~63
    if kind[0] not in "LN":
        return ""
    script = lambda c: u.name(c, "").split(" ")[0]
    around = [chr(o) for o in range(base, base + 64) if u.category(chr(o)) == kind and script(chr(o)) == script(low)]
    return "".join(c for c in around if kind != "Ll" or len(c.upper()) == 1 and c.upper().lower() == c) if len(low.upper()) == 1 else ""


class Surrogates:
    """Keyed one-to-one replacements that leave no piece as it is."""

    def __init__(self, key: str):
        self.key = key.encode()
        self.swap: dict[str, str] = {}
        taken = {n.casefold() for n in [*FEMALE, *MALE]}
        for names_ in (FEMALE, MALE):
            ring = sorted(names_, key=lambda x: self._h("list", x))
            to = dict(zip(ring, ring[1:] + ring[:1]))
            self.swap |= {a.casefold(): b for a, b in to.items()}
            for full in sorted(names_):  # short forms follow their full name; where the new one has too few, it is cut to one
                own, new = [n for n in NICKNAMES if NICKNAMES[n] == full], [n for n in NICKNAMES if NICKNAMES[n] == to[full]]
                for i, n in enumerate(own):
                    cuts = [*new[i:], *(to[full][:k] for k in range(3, len(to[full]))), *(to[full][:3] + c for c in "aeiouy")]
                    short = next(c for c in cuts if c.casefold() not in taken and c != n)
                    taken.add(short.casefold())
                    self.swap[n.casefold()] = short
        plain = lambda x: "".join(c for c in u.normalize("NFD", x) if not u.combining(c))
        self.swap |= {plain(a): plain(b) for a, b in self.swap.items() if plain(a) != a and plain(b) != b}

    def _h(self, *what: object) -> int:
        return int.from_bytes(hmac.new(self.key, "\x1f".join(map(str, what)).encode(), hashlib.sha256).digest()[:8], "big")

    @lru_cache(maxsize=100_000)  # noqa: B019
    def _next(self, alphabet: str, context: str) -> dict[str, str]:
        ring = sorted(alphabet, key=lambda c: self._h(alphabet, context, c))
        return dict(zip(ring, ring[1:] + ring[:1]))

    def letters(self, w: str, kind: str) -> str:
        """Letter for letter within the script; what precedes decides the cycle, so it is one-to-one and no letter stays."""
        out, seen = [], kind
        for c in w:
            low = c.lower() if len(c.lower()) == 1 else c
            if len(alphabet := _alphabet(low)) > 1 and low in alphabet:
                r = self._next(alphabet, seen)[low]
                out.append(r.upper() if c != low else r)
            else:
                out.append(c)
            seen += low
        return "".join(out)

    def name(self, s: str) -> str:
        def one(m: re.Match) -> str:
            w = m[0]
            r = self.swap.get(u.normalize("NFC", w).casefold())
            if r is None:
                return self.letters(w, "surname") if len(w) > 1 else self.letters(w, "initial")
            return r.upper() if w.isupper() and len(w) > 1 else r.lower() if w.islower() else r

        return re.sub(r"[\p{L}\p{M}]+", one, u.normalize("NFC", s))

    def replace(self, kind: str, s: str) -> str:
        if kind == "name":
            return self.name(s)
        if kind == "phone":
            head = re.match(r"(?:\+|00)\d{1,2}(?!\d)|\+1(?=\d{10})", s)
            n = head.end() if head else 0
            return s[:n] + self.letters(s[n:], "phone")
        if kind == "email":
            keep = ("at", "dot", "example", "test", "com", "org", "net")
            m = re.search(r"(?i)\s*(?:@|[\[({]at[\])}]|\sat\s)", s)
            local, rest = (s[: m.start()], s[m.start() :]) if m else ("", s)
            return re.sub(r"[^\W\d_]+|\d+", lambda m: self.name(m[0]) if m[0].isalpha() else self.letters(m[0], "email"), local) + re.sub(r"[^\W_]+", lambda m: m[0] if m[0].lower() in keep else self.letters(m[0], "domain"), rest)
        if kind == "address":
            keep = re.compile(rf"(?i)(?:{_SUFFIX}|Apt|Flat|Unit|Suite|Rue|Calle|Via|Avenida|Plaza|Am|Im|C|n|nº|des|del|de|la)$")
            return re.sub(r"[^\W_]+", lambda m: m[0] if keep.match(m[0]) else self.letters(m[0], "address"), s)
        return self.letters(s, kind)


def pieces(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pii_type, pii_text), distinct, each piece as it stands in the text. Null or empty texts have none."""
    learnt = learn(df, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, t[s:e]) for i, t in zip(b["id"], b["text"]) for s, e, k in find(t, learnt)]
            yield pd.DataFrame(rows, columns=["id", "pii_type", "pii_text"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInPandas(run, f"id {kind}, pii_type string, pii_text string").distinct()


def redact(df: DataFrame, id_col: str, text_col: str, key: str, out: str = "text") -> DataFrame:
    """(id, text): every piece replaced by [TYPE:surrogate]; the rest stands unchanged. Null stays null."""
    learnt = learn(df, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = Surrogates(key)
        for b in batches:
            res = []
            for t in b["text"]:
                if t is not None:
                    for s, e, k in reversed(find(t, learnt)):
                        t = f"{t[:s]}[{k.upper()}:{z.replace(k, t[s:e])}]{t[e:]}"
                res.append(t)
            yield pd.DataFrame({"id": b["id"], out: res})

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInPandas(run, f"id {kind}, {out} string")


def collisions(found: DataFrame, key: str) -> DataFrame:
    """The check of the surrogates over a whole table: by type the distinct pieces, their distinct surrogates, how many surrogates
    stand for more than one piece, and how many pieces are their own surrogate; the last two are 0. Letter marks are compared composed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = Surrogates(key)
        for b in batches:
            yield b.assign(surrogate=[z.replace(k, t) for k, t in zip(b["pii_type"], b["pii_text"])])

    d = found.select("pii_type", "pii_text").distinct().mapInPandas(_composed, "pii_type string, pii_text string").distinct().mapInPandas(run, "pii_type string, pii_text string, surrogate string")
    d = d.groupBy("pii_type", "surrogate").agg(F.count("*").alias("originals"), F.count_if(F.col("pii_text") == F.col("surrogate")).alias("same"))
    return d.groupBy("pii_type").agg(F.sum("originals").alias("pieces"), F.count("*").alias("surrogates"), F.count_if(F.col("originals") > 1).alias("collisions"), F.sum("same").alias("unchanged"))


def _composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(pii_text=b["pii_text"].map(lambda t: u.normalize("NFC", t)))
