"""Personal data by weak supervision.

Base patterns (email, ip, card, phone) find spans outright. Beyond them, looser candidates are judged: labelling
functions of three sorts (patterns and checksums, gazetteers, context words) vote for or against each candidate or
abstain; expectation-maximisation over the counts of vote patterns estimates, without labelled data, the share of
personal data among the candidates of a kind and how often each function is right; and the posteriors train a logistic span classifier on features of the candidate and its surroundings, whose
positives are added. Nothing but the estimates says how much a vote counts.

One pass over all texts gathers candidates' votes and features, kept as narrow rows. Vote patterns are counted over
all of them (a count for each pattern: at most 3 to the number of functions, for each kind); the classifier is fitted
on a bounded sample of TRAIN_SPANS distinct candidates, each weighing as much as it is frequent. A second pass over all
texts applies it. Nothing of a text is shuffled.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import blocks, durable, keyed_texts, prepared, table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the method adds, after the base kinds in the order of equal starts.
ALL_KINDS = (*KINDS, "account", "name", "number")
TRAIN_SPANS = 20_000
FEATURES = 1 << 14
THRESHOLD = 0.5
#: Rounds of expectation-maximisation and of gradient descent.
EM_ROUNDS, FIT_ROUNDS = 100, 300
#: Votes that smooth a function's rates.
SMOOTHING = 4
#: The weight of abstaining (functions see much alike, so silence of several is one fact), and the largest share of personal data assumed.
QUIET, MOST = 0.5, 0.9

Span = tuple[int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Found from the first dot: patterns that begin with what is rare are searched for fast.
IP_REST = re.compile(r"\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Looser candidates: groups of seven or more digits, account numbers, anything around an at sign, addresses spelt out, two or three capitalised words.
DIGIT_RUN = re.compile(r"[0-9](?:[ ().\-/]{0,2}[0-9]){6,}")
DIGITS = re.compile(r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[ ().\-/]{0,2}[0-9]){6,}(?![0-9A-Za-z])")
ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
AROUND_AT = re.compile(r"[^\s@<>\"',;]{1,64}\Z"), re.compile(r"[^\s@<>\"',;]{1,255}")
SPELT_AT = re.compile(r" ?[\[({] ?at ?[\])}] ?| at ", re.IGNORECASE)
BRACKET_AT = re.compile(r"[\[({] ?[aA][tT] ?[\])}]")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
SPELT_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: ?[\[({] ?dot ?[\])}] ?| dot |\.)[A-Za-z0-9-]{1,63}){1,4}", re.IGNORECASE)
SPELT_DOT = re.compile(r" ?[\[({] ?dot ?[\])}] ?| dot ", re.IGNORECASE)
CAPITALISED = re.compile(r"[A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20}){1,2}\b")

# Gazetteers and context words, general knowledge in the languages at hand.
GIVEN_NAMES = frozenset("""Aaron Adam Adrian Agnes Alan Albert Alejandro Alexander Alice Amanda Amy Andrea Andreas Andrew Angela Anita Anna Anne Anthony Antoine Antonio
 Barbara Beatriz Benjamin Bernard Bernd Betty Brenda Brian Bruno Camille Carla Carlos Carmen Carol Caroline Catherine Cecilia Charles Charlotte Christian Christina Christine Claire Clara Claudia
 Cristina Daniel Daniela David Deborah Dennis Diana Diego Dieter Dominique Donald Donna Dorothy Eduardo Edward Elena Elizabeth Emily Emma Enrique Eric Erika Esther Eva Evelyn Felix Fernando Florian
 Francisco Frank Gabriel Gabriela George Gerard Gloria Grace Greta Hannah Hans Heather Heidi Helen Helga Henri Henry Ingrid Irene Isabel Isabelle Jack Jacob Jacques James Jan Jane Janet Javier Jean
 Jennifer Jessica Joan Johannes John Jonathan Jorge Jose Joseph Juan Julia Julie Karen Karl Katharina Kathleen Kevin Klaus Laura Linda Lisa Lucas Lucia Luis Luise Manuel Marc Marcel Marco Margaret Maria
 Marie Mark Marta Martin Mary Matthew Max Melissa Michael Michel Michelle Miguel Monika Nancy Natalie Nicolas Nicole Olivier Oscar Pablo Patricia Patrick Paul Paula Pedro Peter Philippe Pierre Rafael
 Rachel Rebecca Renate Richard Robert Roberto Rosa Ruth Samuel Sandra Sarah Sebastian Silvia Simon Sofia Sophie Stefan Stephanie Steven Susan Susanne Sylvie Teresa Thomas Ursula Valerie Victor Victoria
 Vincent Walter Werner William Wolfgang Yvonne""".split())
PROVIDERS = frozenset("aol comcast fastmail free freenet gmail gmx googlemail hotmail hushmail icloud laposte libero live mac mail mailbox msn orange outlook posteo proton protonmail qq rediffmail sfr tuta verizon wanadoo web yahoo yandex ymail zoho".split())
ENDINGS = frozenset("ar at au be biz br ca ch cl cn co com cz de dk edu es eu fi fr gov gr hu ie in info int io it jp kr me mil mx net nl no nz org pe pl pt ro ru se tr ua uk us za".split())
TITLES = frozenset("dr doctor frau herr lady lord madame miss monsieur mr mrs ms prof professor señor señora sir".split())
CONTEXT = frozenset("account call card cell contact correo courriel credit dear email fax iban kontakt konto kreditkarte llamar mail mailto mobile mobil móvil name named nom nombre passport phone rufen signed ssn tarjeta tel telefon telephone teléfono téléphone carte visa whatsapp write".split())
AGAINST = frozenset("article chapter edition figure invoice isbn issn item kapitel model number order page pages part price rechnung section seite serial sku size table total version vol volume year".split())
PLACES = frozenset("Academy America Apache Avenue Bank Bay Berlin Building Center City Club College Company Corporation County East England Europe Foundation Friday Germany Group Hill House Institute Island Lake License London Madrid Monday Mountain Museum National New North Paris Park River Road Royal San Saturday School South Spain Square State States Station Street Sunday The Thursday Tuesday Union United University Version Wednesday West World York".split())
TITLE = re.compile("(?:" + "|".join(sorted(TITLES)) + ") ", re.IGNORECASE)
WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses, found from their at signs: linear in the text."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", max(at + 1, floor))
    return found


def ips(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of four runs of digits between dots."""
    found, m = [], IP_REST.search(text)
    while m:
        start = m.start()
        while start and "0" <= text[start - 1] <= "9":
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            m = IP_REST.search(text, m.end())
        else:
            m = IP_REST.search(text, m.start() + 1)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns by start, then kind as listed."""
    found = [("email", *s) for s in emails(text)]
    found += [("ip", s, e) for s, e in ips(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in text[s:e].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(only_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], ALL_KINDS.index(s[0])))


def iban(text: str) -> bool:
    code = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def spelt_emails(text: str) -> list[Span]:
    """Addresses whose at sign, and maybe dots, are written as words."""
    at = [m.span() for m in BRACKET_AT.finditer(text)]
    for word in (" at ", " At ", " AT "):
        place = text.find(word)
        while place >= 0:
            at.append((place, place + 4))
            place = text.find(word, place + 1)
    found = []
    for start, end in sorted(at):
        start, end = start - (text[start - 1 : start] == " "), end + (text[end : end + 1] == " " and text[end - 1] != " ")
        left, right = LOCAL_END.search(text[max(0, start - 64) : start]), SPELT_HOST.match(text, end)
        if left and right:
            found.append((start - len(left[0]), right.end()))
    return found


def at_words(pattern: re.Pattern, text: str) -> Iterator[Span]:
    """Matches that begin at a word's begin, leftmost and non-overlapping."""
    m = pattern.search(text)
    while m:
        s = m.start()
        if s and (text[s - 1].isalnum() or text[s - 1] == "_"):
            m = pattern.search(text, s + 1)
        else:
            yield m.span()
            m = pattern.search(text, m.end())


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Looser spans of kinds email, account, name and number that might be personal data."""
    found = [("email", *s) for s in spelt_emails(text)]
    at = text.find("@")
    while at >= 0:
        left, right = AROUND_AT[0].search(text[max(0, at - 64) : at]), AROUND_AT[1].match(text, at + 1)
        if left and right:
            found.append(("email", at - len(left[0]), right.end()))
        at = text.find("@", at + 1)
    for run in DIGIT_RUN.finditer(text):
        found += [("number", m.start(), m.end()) for m in DIGITS.finditer(text, max(0, run.start() - 2), run.end() + 1)]
    found += [("account", *s) for s in at_words(ACCOUNT, text)]
    for s, e in at_words(CAPITALISED, text):
        titled = TITLE.match(text, s, e)
        first = titled.end() if titled else s
        if not titled or " " in text[first:e]:
            found.append(("name", first, e))
    return sorted(found, key=lambda s: (s[1], ALL_KINDS.index(s[0]), s[2]))


def near_words(text: str, start: int, end: int) -> tuple[set[str], set[str]]:
    """Lower-cased words within 30 characters before and after."""
    return {w.lower() for w in WORD.findall(text[max(0, start - 30) : start])}, {w.lower() for w in WORD.findall(text[end : end + 30])}


FUNCTIONS = ("shape", "checksum", "gazetteer", "counter-gazetteer", "words before", "words after", "counter-words")
GROUPED = re.compile(r"\+?\(?[0-9]{1,4}\)?(?:[ ().\-/]{1,2}[0-9]{2,5}){1,5}")
DATED = re.compile(r"(?:19|20)[0-9]{2}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}.*|[0-9]{1,2}[-/. ][0-9]{1,2}[-/. ](?:19|20)[0-9]{2}.*|97[89][- ]?[0-9].*", re.DOTALL)


def votes(text: str, kind: str, start: int, end: int) -> str:
    """A vote of each labelling function: + for personal data, - against, 0 none."""
    span = text[start:end]
    before, after = near_words(text, start, end)
    shape = checksum = place = against = "0"
    doubted = bool(before & AGAINST)
    if kind == "number":
        digits = only_digits(span)
        checksum = "0" if not 13 <= len(digits) <= 19 else "+" if luhn(digits) else "-"
        against = "-" if DATED.fullmatch(span) or len(set(digits)) <= 2 else "0"
        shape = "+" if GROUPED.fullmatch(span) and 9 <= len(digits) <= 15 and against == "0" and not doubted else "0"
        place = "+" if span[0] in "+(" else "0"
    elif kind == "account":
        checksum = "+" if iban(span) else "-"
        shape = "+" if 15 <= len(span.replace(" ", "")) <= 34 else "-"
        place = "+" if span[:2].lower() in ENDINGS else "-"
    elif kind == "email":
        spelt = SPELT_AT.search(span)
        host = span[spelt.end() :] if spelt else span.partition("@")[2]
        parts = SPELT_DOT.sub(".", host).rstrip(".").lower().split(".")
        plain = bool(spelt) and spelt[0].lower() == " at " and not SPELT_DOT.search(host)
        shape = "0" if plain else "+" if len(parts) > 1 and all(re.fullmatch(r"[\w-]+", p) for p in parts) and parts[-1].isalpha() else "-"
        place = "+" if parts[0] in PROVIDERS or len(parts) > 1 and parts[-1] in ENDINGS else "0"
        against = "-" if len(parts) < 2 or parts[-1] not in ENDINGS else "0"
    else:
        words = span.split(" ")
        shape = "+" if before & TITLES else "0"
        against = "-" if PLACES & set(words) or len(set(words)) < len(words) else "0"
        place = "+" if words[0] in GIVEN_NAMES and against == "0" else "0"
    return shape + checksum + place + against + ("+" if before & CONTEXT else "0") + ("+" if after & CONTEXT else "0") + ("-" if doubted else "0")


def bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


def features(text: str, kind: str, start: int, end: int, cast: str) -> list[int]:
    """Hashed features of a candidate: its shape, its surroundings and its votes."""
    span = text[start:end]
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 6)}", span))[:40]
    before, after = near_words(text, start, end)
    names = [f"k={kind}", f"k={kind} shape={shape}", f"k={kind} digits={min(20, len(only_digits(span)))}", f"k={kind} in={text[max(0, start - 1) : start]}", f"k={kind} out={text[end : end + 1]}"]
    names += [f"k={kind} {name}={vote}" for name, vote in zip(FUNCTIONS, cast, strict=True)]
    return sorted({bucket(n) for n in [*names, *(f"b={w}" for w in before & (CONTEXT | AGAINST | TITLES)), *(f"a={w}" for w in after & (CONTEXT | AGAINST | TITLES))]})


def estimated(cast: np.ndarray, n: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, float, np.ndarray]:
    """Posteriors of vote patterns (rows of -1, 0, 1) that n candidates each have, the share of personal data, and rates.

    rates[truth, function, vote + 1] is how often a function votes so on candidates that are personal data (1) or not
    (0); votes are independent given the truth. Truth begins as the majority of votes, which is also the answer if there
    are no rounds; then rates and share follow from truth, and truth from them. A function may turn out to say nothing,
    but a vote for never counts against, nor one against for. The share is at most MOST.
    """
    truth, seen = 1 / (1 + np.exp(-1.5 * cast.sum(axis=1) + 0.5)), np.stack([cast == v for v in (-1, 0, 1)], axis=2).astype(float)
    lean = SMOOTHING * np.array([[0.3, 0.6, 0.1], [0.1, 0.6, 0.3]])
    share, rates = 0.5, np.zeros((2, cast.shape[1], 3))
    for _ in range(rounds):
        share = min(MOST, float((truth @ n + 1) / (n.sum() + 2)))
        counts = np.stack([np.einsum("p,pfv->fv", w * n, seen) for w in (1 - truth, truth)]) + lean[:, None, :]
        rates = counts / counts.sum(axis=2, keepdims=True)
        weight = np.log(rates[1] / rates[0])
        weight[:, 0], weight[:, 2] = np.minimum(weight[:, 0], 0), np.maximum(weight[:, 2], 0)
        weight[:, 1] *= QUIET
        truth = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + np.einsum("pfv,fv->p", seen, weight), -30, 30)))
    return truth, share, rates


def posteriors(patterns: dict[tuple[str, str], int], rounds: int = EM_ROUNDS) -> dict[tuple[str, str], float]:
    """The chance that a candidate is personal data, for each (kind, votes) with a vote, estimated for each kind apart."""
    patterns = {p: n for p, n in patterns.items() if set(p[1]) != {"0"}}
    out: dict[tuple[str, str], float] = {}
    for kind in sorted({k for k, _ in patterns}):
        seen = sorted(v for k, v in patterns if k == kind)
        cast = np.array([["-0+".index(c) - 1 for c in v] for v in seen])
        truth, _, _ = estimated(cast, np.array([patterns[kind, v] for v in seen], float), rounds)
        out |= {(kind, v): float(t) for v, t in zip(seen, truth, strict=True)}
    return out


@dataclass
class Detector:
    """Weights of the span classifier, the last one its constant."""

    weights: np.ndarray

    def chance(self, features: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[features].sum() + self.weights[-1], -30, 30))))

    def spans(self, text: str, base: list[tuple[str, int, int]] | None = None) -> list[tuple[str, int, int]]:
        """Base spans and the candidates that the classifier accepts, which don't overlap them or each other.

        A candidate is free of base spans if those that begin before its end don't reach beyond its start. What no
        function speaks for is never added.
        """
        base = base_spans(text) if base is None else base
        starts, reach = [s for _, s, _ in base], [0, *accumulate((e for _, _, e in base), max)]
        out, free = list(base), 0
        for kind, s, e in candidates(text):
            if s < max(free, reach[bisect_left(starts, e)]) or "+" not in (cast := votes(text, kind, s, e)):
                continue
            if self.chance(features(text, kind, s, e, cast)) >= THRESHOLD:
                out.append((kind, s, e))
                free = e
        return sorted(out, key=lambda s: (s[1], ALL_KINDS.index(s[0]), s[2]))


def fitted(rows: list[tuple[list[int], float, int]], rounds: int = FIT_ROUNDS) -> Detector:
    """Logistic regression on soft labels by AdaGrad over rows of features, label and weight. Without rows, nothing is accepted."""
    weights = np.zeros(FEATURES + 1)
    if not rows:
        weights[-1] = -30
        return Detector(weights)
    sizes = np.array([len(f) + 1 for f, _, _ in rows])
    flat = np.concatenate([np.array([*f, FEATURES]) for f, _, _ in rows])
    row, y, n = np.repeat(np.arange(len(rows)), sizes), np.array([t for _, t, _ in rows]), np.array([w for _, _, w in rows], float)
    squares = np.full(FEATURES + 1, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[flat], len(rows)), -30, 30)))
        gradient = np.bincount(flat, ((p - y) * n)[row], FEATURES + 1) / n.sum() + 1e-5 * weights
        squares += gradient**2
        weights -= 0.5 * gradient / np.sqrt(squares)
    return Detector(weights)


def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, votes, features) of every candidate."""
    for block in blocks(batches):
        rows = []
        for text in block["text"].to_pylist():
            found = candidates(text)
            rows += [(c[0], v, features(text, *c, v)) for c, v in zip(found, (votes(text, *c) for c in found), strict=True)]
        if rows:
            kind, vote, feature = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(vote), pa.array(feature, pa.list_(pa.int32()))], names=["kind", "votes", "features"])


def train(df: DataFrame, text_col: str = "text", train_spans: int = TRAIN_SPANS, rounds: int = EM_ROUNDS) -> Detector:
    """A detector from the candidates of all texts; the classifier sees at most train_spans distinct ones, chosen by a hash, with their counts."""
    texts = prepared(df.select(text_or_empty(text_col).alias("text")))
    found = durable(texts.mapInArrow(judged, "kind string, votes string, features array<int>").groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n")))
    patterns = {(r["kind"], r["votes"]): r["n"] for r in found.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()}
    truth = posteriors(patterns, rounds)
    sample = found.orderBy(F.xxhash64("kind", "votes", "features"), "kind", "votes", "features").limit(train_spans).collect()
    return fitted([(r["features"], truth[r["kind"], r["votes"]], r["n"]) for r in sample if (r["kind"], r["votes"]) in truth])


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def finder(sent) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = sent.value
        for block in blocks(batches):
            base = [base_spans(t) for t in block["text"].to_pylist()]
            spans = [detector.spans(t, b) for t, b in zip(block["text"].to_pylist(), base, strict=True)]
            counts = [[sum(k == kind for k, _, _ in b) for b in base] for kind in KINDS]
            columns = [block["doc_id"], *(pa.array(c, pa.int64()) for c in counts), pa.array(map(written, base), pa.string()), pa.array(map(written, spans), pa.string())]
            yield from pa.table(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"]).to_batches()

    return run


def personal_data(df: DataFrame, detector: Detector | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base and spans of every row of df.

    base and spans are kind:start:end (code points, end exclusive), comma-joined, by start, then kind as in ALL_KINDS.
    Null and empty texts have none; repeated rows give repeated rows; null ids stay null; no rows give no rows.
    """
    detector = detector or train(df, text_col)
    texts = keyed_texts(df, id_col, text_col)
    sent = df.sparkSession.sparkContext.broadcast(detector)
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return texts.mapInArrow(finder(sent), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {counts}, base string, spans string")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, of the first kind."""
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def masker(sent) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = sent.value
        for block in blocks(batches):
            texts = [None if t is None else masked(t, detector.spans(t)) for t in block["text"].to_pylist()]
            yield from block.set_column(block.schema.get_field_index("text"), "text", pa.array(texts, pa.string())).to_batches()

    return run


def redacted(df: DataFrame, detector: Detector | None = None) -> DataFrame:
    """df with the personal data in its column text replaced by their kinds; null texts stay null."""
    sent = df.sparkSession.sparkContext.broadcast(detector or train(df))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return prepared(df).mapInArrow(masker(sent), fields)


def digest(spans: str) -> Column:
    return F.sha2(spans, 256)


def op1_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), digest("base").alias("base_sha256"), "spans")
