"""Subject areas of documents: labelling functions aggregated by a latent model that learns how accurate they are.

Labelling functions vote on each pair of a document and a subject: a lexicon over the text (how much of what a document
mentions belongs to the subject), the section it stands in (subject line, own text, quoted text), the sender's address and
the source. The lexicon and the address and source tables are fitted on a bounded sample of labelled documents (SAMPLE);
the reliabilities of the votes are learnt by expectation maximisation over the vote patterns of all documents, with labels
as one more, fallible voter. A pair whose posterior reaches one half is assigned.

Messages are read whole: parts in base64 or quoted-printable are decoded, quoted text counts; headers other than the
subject, signatures and postscripts do not.
"""

from __future__ import annotations

import binascii
import math
import quopri
import re
from base64 import b64decode
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.session import cut

SAMPLE, PER_SUBJECT = 20_000, 2_000
#: Steps of a subject's share of all mentions; from the third step on a pair is taken for true at first, if there are two mentions.
SHARES, FIRST = (0.1, 0.17, 0.24, 0.35, 0.6), 3

_HEAD_END = re.compile(r"\n[ \t]*\n")
_ENCODING = re.compile(r"(?im)^content-transfer-encoding:[ \t]*(base64|quoted-printable)")
_TYPE = re.compile(r"(?im)^content-type:[ \t]*([\w/+.-]+)")
_BOUNDARY = re.compile(r"(?i)boundary=\"?([^\"\s;]+)")
_SUBJECT = re.compile(r"(?im)^subject:[ \t]*(.*(?:\n[ \t]+.*)*)")
_FROM = re.compile(r"(?im)^from:.*?@([\w.-]+)")
_WORD = re.compile(r"=\?([\w-]+)\?([bBqQ])\?([^?]*)\?=")
_QUOTE = re.compile(r"^[ \t]*(?:[>|][>| \t]*)")
_PS = re.compile(r"(?i)^\W*(?:p\.?\s?s\.?|p\.?\s?d\.?|n\.?\s?b\.?)\s*[:.-]")
_FIELD = re.compile(r"(?i)^(?:from|sent|to|cc|subject|date|von|gesendet|an|betreff|de|enviado|para|asunto|datum|fecha)\s*:")
_TAG = re.compile(r"<(?:style|script)[^>]*>.*?</(?:style|script)>|<[^>]{1,400}>", re.S | re.I)
_TOKEN = re.compile(r"[^\W\d_]+")


def _charset(head: str) -> str:
    m = re.search(r"(?i)charset=\"?([\w-]+)", head)
    return m[1].lower() if m else "utf-8"


def _bytes(raw: bytes, head: str) -> str:
    for c in ("utf-8", _charset(head), "latin-1"):
        try:
            return raw.decode(c)
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("latin-1")


def _mended(s: str) -> str:
    """Text once read in the wrong character set, read again in the right one."""
    if "Ã" not in s and "â€" not in s:
        return s

    def again(m: re.Match) -> str:
        try:
            return m[0].encode("cp1252", "strict").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            try:
                return m[0].encode("latin-1", "strict").decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                return m[0]

    return re.sub(r"[Â-ô][\u0080-¿Œ-™]+", again, s)


def _words(m: re.Match) -> str:
    try:
        raw = b64decode(m[3] + "===") if m[2] in "bB" else quopri.decodestring(m[3].replace("_", " ").encode("latin-1", "replace"))
        return raw.decode(m[1], "replace")
    except (binascii.Error, LookupError, ValueError):
        return " "


def _part(head: str, body: str) -> str:
    e, t = _ENCODING.search(head), _TYPE.search(head)
    kind = t[1].lower() if t else "text/plain"
    if e and e[1].lower() == "base64":
        if not kind.startswith(("text/", "message/")):
            return ""
        try:
            body = _bytes(b64decode(re.sub(r"[^A-Za-z0-9+/]", "", body) + "==="), head)
        except (binascii.Error, ValueError):
            return ""
    elif e:
        body = _bytes(quopri.decodestring(body.encode("utf-8", "replace")), head)
    elif not kind.startswith(("text/", "message/", "multipart/")):
        return ""
    if kind.startswith("message/") and re.match(r"[\w-]+:", body.lstrip()):
        body = body.lstrip()
        k = _HEAD_END.search(body)
        return _part(body[: k.start()], body[k.end() :]) if k else ""
    if "html" in kind or "<html" in body[:200].lower():
        body = _TAG.sub(" ", body).replace("&nbsp;", " ").replace("&amp;", "&")
    return body


def sections(text: str | None) -> tuple[str, str, list[str], list[str]]:
    """(sender's domain, subject line, own lines, quoted lines) of a message; empty ones for null or empty text."""
    if not text:
        return "", "", [], []
    s = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("\n \t\ufeff")
    s = re.sub(r"^From \S[^\n]*\n", "", s)
    cut_at = _HEAD_END.search(s)
    head, body = (s[: cut_at.start()], s[cut_at.end() :]) if cut_at else ("", s)
    if not re.match(r"[\w-]+:", head):
        head, body = "", s
    m, f = _SUBJECT.search(head), _FROM.search(head)
    subject = _mended(_WORD.sub(_words, m[1])) if m else ""
    parts = []
    if b := _BOUNDARY.search(head):
        stack = [(b[1], body)]
        while stack:
            mark, rest = stack.pop()
            for p in rest.split(f"--{mark}")[1:]:
                p = p.lstrip("\n")
                if p.startswith("--"):
                    continue
                k = _HEAD_END.search(p) if re.match(r"[\w-]+:", p) else None
                ph, pb = (p[: k.start()], p[k.end() :]) if k else ("", p)
                if (inner := _BOUNDARY.search(ph)) and inner[1] != mark and len(stack) < 20:
                    stack.append((inner[1], pb))
                else:
                    parts.append(_part(ph, pb))
    else:
        parts.append(_part(head, body))
    own, quoted, after = [], [], False
    for p in parts:
        p = _mended(p)
        signature = False
        deep = False
        for line in p.split("\n"):
            bare = _QUOTE.sub("", line)
            q = bare is not line and bare != line
            t = bare.strip()
            if t in ("--", "-- ") or re.fullmatch(r"[-_]{2}\s*", bare):
                signature = True
                continue
            if signature and (not t or q != deep):
                signature = False
            deep = q
            if re.match(r"(?i)-+\s*(?:original message|urspr\S+ nachricht|mensaje original|forwarded message|weitergeleitete nachricht)", t):
                after = True
                continue
            if not t or signature or _PS.match(t) or _FIELD.match(t):
                continue
            (quoted if q or after else own).append(t)
        after = False
    return (f[1].lower() if f else ""), subject, own, quoted


def grams(lines: list[str]) -> Iterator[list[str]]:
    for line in lines:
        w = _TOKEN.findall(line.lower())
        if w:
            yield w


def _mentions(lines: list[str], lexicon: dict[str, int]) -> Counter:
    """How often each subject is mentioned: two-word terms first, then single words."""
    n: Counter = Counter()
    get = lexicon.get
    for w in grams([" ".join(lines)]):
        i, k = 0, len(w)
        while i < k:
            s = get(w[i] + " " + w[i + 1]) if i + 1 < k else None
            if s is not None:
                i += 1
            else:
                s = get(w[i])
            if s is not None:
                n[s] += 1
            i += 1
    return n


def _features(text: str) -> tuple[set[str], str]:
    domain, subject, own, quoted = sections(text)
    out: set[str] = set()
    for w in grams([subject, " ".join(own), " ".join(quoted)]):
        out.update(w)
        out.update(a + " " + b for a, b in zip(w, w[1:]))
    return out, domain


class Tables:
    """What the labelling functions know, all of bounded size."""

    def __init__(self, subjects: list[str], lexicon: dict[str, int], domains: dict[str, dict[int, int]], sources: dict[str, dict[int, int]]):
        self.subjects, self.lexicon, self.domains, self.sources = subjects, lexicon, domains, sources


def _learn(docs: DataFrame, subjects: list[str]) -> Tables:
    """docs: doc_id, text, source, labels (array of subjects) -> the tables."""
    at = {s: i for i, s in enumerate(subjects)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for b in batches:
            for t, src, ls in zip(b["text"], b["source"], b["labels"]):
                f, domain = _features(t)
                own = {at[x] for x in ls if x in at}
                for kind, values in (("w", f), ("d", [domain]), ("s", [src or ""]), ("*", [""])):
                    for v in values:
                        c[kind, v, -1] += 1
                        for i in own:
                            c[kind, v, i] += 1
        yield pd.DataFrame([(*k, n) for k, n in c.items()], columns=["kind", "value", "subject", "n"])

    n = docs.mapInPandas(count, "kind string, value string, subject int, n long").groupBy("kind", "value", "subject").agg(F.sum("n").alias("n"))
    n = cut(n.where("n > 1 or kind <> 'w'"))
    base = {r["subject"]: r["n"] for r in n.where("kind = '*'").collect()}
    total = max(base.get(-1, 0), 1)
    least = 2 if total < 300 else 3 if total < 2_000 else 5
    seen = n.where("kind = 'w' and subject = -1").select("value", F.col("n").alias("df"))
    prior = F.create_map(*[F.lit(x) for i in range(len(subjects)) for x in (i, base.get(i, 0) / total)])
    hit = n.where(f"kind = 'w' and subject >= 0 and n >= {least}").join(seen, "value")
    p = (F.col("n") - 0.5) / F.col("df")
    hit = hit.withColumn("p", p).where((F.col("p") >= 0.6) & (F.col("p") >= prior[F.col("subject")] * 0.6 + 0.4))
    best = hit.withColumn("rk", F.row_number().over(Window.partitionBy("subject").orderBy(F.desc(F.col("p") * F.log1p("n")), "value"))).where(F.col("rk") <= PER_SUBJECT)
    lexicon: dict[str, tuple[float, int]] = {}
    for r in best.select("value", "subject", "p").collect():
        if (r["p"], -r["subject"]) > lexicon.get(r["value"], (0.0, 0)):
            lexicon[r["value"]] = (r["p"], -r["subject"])
    ties: dict[str, dict[str, dict[int, int]]] = {"d": {}, "s": {}}
    whole = {(r["kind"], r["value"]): r["n"] for r in n.where("kind in ('d', 's') and subject = -1 and n >= 8").orderBy(F.desc("n")).limit(5_000).collect()}
    for r in n.where("kind in ('d', 's') and subject >= 0").join(F.broadcast(docs.sparkSession.createDataFrame([(*k,) for k in whole], "kind string, value string")), ["kind", "value"]).collect() if whole else []:
        odds = (r["n"] + 1) / (whole[r["kind"], r["value"]] + 1 / max(base.get(r["subject"], 1) / total, 1e-3)) / max(base.get(r["subject"], 1) / total, 1e-3)
        ties[r["kind"]].setdefault(r["value"], {})[r["subject"]] = 1 if odds > 1.5 else -1 if odds < 0.67 else 0
    return Tables(subjects, {k: -v[1] for k, v in lexicon.items()}, ties["d"], ties["s"])


#: Votes that say nothing, by labelling function: own text only, no or another subject in the subject line, no tie of address or source.
ABSTAIN = ((), (1,), (0, 1), (1,), (1,))
#: One vote besides the share of mentions changes the odds at most by this, as logarithm.
LIMIT = 1.0
_VOTES = "doc_id long, subject int, share int, place int, header int, address int, source int"


def _vote(t: Tables, doc_id: int, text: str | None, source: str | None) -> list[tuple]:
    """The votes on every subject that the document mentions."""
    domain, subject, own, quoted = sections(text)
    a, b, h = _mentions(own, t.lexicon), _mentions(quoted, t.lexicon), _mentions([subject], t.lexicon)
    both = a + b
    total = sum(both.values()) + sum(h.values())
    out = []
    for s in {*both, *h}:
        n = both[s] + h[s]
        r = n / total
        share = 3 * sum(r >= x for x in SHARES) + min(n, 3) - 1
        place = 0 if a[s] and b[s] else 1 if a[s] else 2 if b[s] else 3
        header = 0 if not h else 1 if h[s] else 2
        out.append((doc_id, s, share, place, header, t.domains.get(domain, {}).get(s, 0) + 1, t.sources.get(source or "", {}).get(s, 0) + 1))
    return out


def _posterior(patterns: pd.DataFrame, rounds: int = 30) -> dict[tuple, float]:
    """patterns: the five votes, yes / no (documents labelled with and without the subject), n (all). The latent model: votes
    independent given the truth, labels right with a rate that is learnt as well."""
    votes = ["share", "place", "header", "address", "source"]
    keys = patterns[votes].to_numpy()
    yes, no, n = (patterns[c].to_numpy(float) for c in ("yes", "no", "n"))
    rest = np.maximum(n - yes - no, 0)
    strong = (keys[:, 0] // 3 >= FIRST) & ((keys[:, 0] % 3 >= 1) | (keys[:, 0] // 3 > FIRST))
    # The share of mentions is calibrated on the labels: it anchors the latent class, on whose strength the others are learnt.
    start = np.where(strong, 0.9, 0.03)
    for k in np.unique(keys[:, 0]):
        at = keys[:, 0] == k
        start[at] = (yes[at].sum() + 4 * start[at][0]) / (yes[at].sum() + no[at].sum() + 4)
    start = np.clip(start, 1e-4, 1 - 1e-4)
    base, q, right = np.log(start / (1 - start)), start.copy(), 0.9
    free = start
    for _ in range(rounds):
        z = base.copy()
        for j in range(1, len(votes)):
            told = ~np.isin(keys[:, j], ABSTAIN[j])
            one, zero = (n * q)[told].sum(), (n * (1 - q))[told].sum()
            for v in np.unique(keys[told, j]):
                at = told & (keys[:, j] == v)
                m = len(np.unique(keys[told, j]))
                z[at] += np.clip(math.log(((n * q)[at].sum() + 1) / (one + m)) - math.log(((n * (1 - q))[at].sum() + 1) / (zero + m)), -LIMIT, LIMIT)
        free = 1 / (1 + np.exp(-z))
        trust = math.log(right / (1 - right))
        with_yes, with_no = 1 / (1 + np.exp(-(z + trust))), 1 / (1 + np.exp(-(z - trust)))
        q = (yes * with_yes + no * with_no + rest * free) / np.maximum(n, 1)
        agree = (yes * with_yes).sum() + (no * (1 - with_no)).sum()
        right = float(np.clip(agree / max(yes.sum() + no.sum(), 1), 0.6, 0.99))
    return {tuple(k): float(f) for k, f in zip(keys.tolist(), free)}


def assign(docs: DataFrame, labels: DataFrame, subjects: list[str], least: float = 0.5) -> DataFrame:
    """(doc_id, subject, posterior) for every subject a document is about.

    docs: doc_id, text, source (null sources are one source of their own). labels: doc_id, subject, several rows and
    contradictions allowed; subjects not in the list (such as "none") say that the document is about none of them. Documents
    with null or empty text get no row; without any label nothing can be learnt and the result is empty.
    """
    spark = docs.sparkSession
    given = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))
    n = given.count()
    few = given.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * min(1.0, 0.95 * SAMPLE / max(n, 1)))) if n > SAMPLE else given
    few = cut(few)  # at most about SAMPLE documents
    d = docs.select("doc_id", "text", "source")
    tables = _learn(d.join(F.broadcast(few), "doc_id"), subjects)
    held = spark.sparkContext.broadcast(tables)

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = held.value
        for b in batches:
            yield pd.DataFrame([r for x in zip(b["doc_id"], b["text"], b["source"]) for r in _vote(t, *x)], columns=_VOTES.replace("long", "").replace("int", "").replace(" ", "").split(","))

    votes = cut(d.where("doc_id is not null").mapInPandas(vote, _VOTES))
    keys = ["share", "place", "header", "address", "source"]
    names = F.array(*[F.lit(s) for s in subjects])
    known = votes.join(given, "doc_id", "left")
    yes = F.col("labels").isNotNull() & F.array_contains("labels", names[F.col("subject")])
    no = F.col("labels").isNotNull() & ~F.array_contains("labels", names[F.col("subject")])
    patterns = known.groupBy(*keys).agg(F.count_if(yes).alias("yes"), F.count_if(no).alias("no"), F.count("*").alias("n")).toPandas()
    if patterns.empty:
        return votes.select("doc_id", F.lit("").alias("subject"), F.lit(0.0).alias("posterior")).limit(0)
    post = spark.createDataFrame([(*map(int, k), p) for k, p in _posterior(patterns).items()], ", ".join(f"{k} int" for k in keys) + ", posterior double")
    return votes.join(F.broadcast(post), keys).where(F.col("posterior") >= least).select("doc_id", names[F.col("subject")].alias("subject"), "posterior")
