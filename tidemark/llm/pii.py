"""Personal data by base patterns and a semi-Markov conditional random field.

The base patterns' spans always stay. Around digits, @ and written-out @ signs, text is cut into tokens, and runs of up to
MOST_TOKENS tokens are candidate entities. Features of a whole candidate (digit groups, check sums, separators, what stands at its
edges and before it) score it for each kind; dynamic programming over the tokens chooses boundaries and kinds jointly, against
leaving tokens out. Weights maximise the conditional likelihood of sentences made by rule with a fixed seed, so that they depend
on no corpus. What it finds beside the base spans is added.

Null texts count as empty and have no spans. Equal texts get equal spans. Further columns are kept by find_spans(), but for one named spans, which gives way. An empty
table gives an empty table. Offsets are code points, ends exclusive. Work for a text is linear in its length.
"""

from __future__ import annotations

import bisect
import math
import random
import re
from collections import defaultdict
from functools import cache
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .secrets import joined

BASE_KINDS = ("email", "ip", "card", "phone")
#: In the order in which spans are listed; national_id comes from the field alone.
KINDS = (*BASE_KINDS, "national_id")
MOST_TOKENS, MOST_CHARS, AROUND = 16, 80, 48
SPANS = "array<struct<kind:string,start:int,end:int>>"

# The base patterns. A digit run is entered at its first digit only, which finds the same spans in linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            out.append((start, done))
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *x) for x in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_byte, m.groups()))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


# ---- the field -------------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\s]")
_ANCHOR = re.compile(r"[0-9@]+|[\[(] ?at ?[\])]", re.IGNORECASE)
_WRITTEN = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[\[(] ?at ?[\])]) ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]+)+", re.IGNORECASE)
_SPACE, _LETTERS = re.compile(r"\s"), re.compile(r"[^\W\d_]*")
_NUMBER = re.compile(r"[+(]?[0-9][0-9 ().+/:-]*")
#: Words before an entity that tell of its kind, or of none.
CUES = {
    "phone": "phone telephone tel call mobile cell fax whatsapp",
    "card": "card visa credit debit mastercard payment",
    "ip": "ip host server address ping",
    "email": "email mail contact write",
    "national_id": "ssn social security national insurance",
    "other": "order invoice no nr version date isbn total price page ref serial ticket",
}
_CUE = {w: k for k, words in CUES.items() for w in words.split()}


def tokens(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, start, end)]


def _features(text: str, s: int, e: int, cue: str) -> list[str] | None:
    """What a whole candidate shows; None for what can't be an entity of any kind."""
    seg = text[s:e]
    out = ["bias", f"cue={cue}"]
    if s and text[s - 1].isalnum():
        out.append("cut_left")
    if e < len(text) and text[e].isalnum():
        out.append("cut_right")
    if _WRITTEN.fullmatch(seg):
        return [*out, "written" if "@" not in seg or " " in seg else "at"]
    if not _NUMBER.fullmatch(seg) or not seg[-1].isdigit():
        return None
    groups = re.findall("[0-9]+", seg)
    digits = "".join(groups)
    if not 7 <= len(digits) <= 19 and not (len(groups) == 4 and len(digits) >= 4):
        return None
    seps = "".join(sorted(set(re.sub("[0-9]", "", seg)))) or "none"
    out += [f"n={len(digits)}", f"seps={seps}", f"groups={len(groups)}", "shape=" + "-".join(str(min(len(g), 9)) for g in groups)]
    if seg[0] == "+":
        out.append("plus")
    if len(digits) >= 13 and luhn(digits):
        out.append("luhn")
    if len(groups) == 4 and seps == "." and all(map(_byte, groups)):
        out.append("quad")
    if s > 1 and text[s - 1] in " .-/:" and text[s - 2].isdigit():
        out.append("more_left")
    if e + 1 < len(text) and text[e] in " .-/:" and text[e + 1].isdigit():
        out.append("more_right")
    return out


def candidates(text: str, toks: list[tuple[int, int]]) -> list[tuple[int, int, list[str]]]:
    """(first token, token after the last, features) of each run of tokens that may be an entity."""
    out, cue, left = [], "none", 0
    for i, (s, e) in enumerate(toks):
        left -= 1
        word = text[s:e]
        if (w := word.lower()) in _CUE:
            cue, left = _CUE[w], 4
        if not (word[0].isdigit() or word[0] in "+(" or (word[0].isalpha() and _near_at(text, s))):
            continue
        digits = 0
        for j in range(i + 1, min(i + MOST_TOKENS, len(toks)) + 1):
            end = toks[j - 1][1]
            if word[0].isdigit() or word[0] in "+(":
                digits += toks[j - 1][1] - toks[j - 1][0] if text[end - 1].isdigit() else 0
                if digits > 19:
                    break
            if end - s > MOST_CHARS or "\n" in text[s:end]:
                break
            if 0 < digits < 4 and word[0] in "+(":
                continue
            if text[end - 1].isalnum() and (f := _features(text, s, end, cue if left > 0 else "none")):
                out.append((i, j, f))
    return out


def _near_at(text: str, s: int) -> bool:
    near = text[s : s + MOST_CHARS].lower()
    return "@" in near or "(at" in near or "[at" in near or "( at" in near or "[ at" in near


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _scores(weights: dict, cands: list) -> list[list[float]]:
    return [[sum(weights.get((k, x), 0.0) for x in f) for k in KINDS] for _, _, f in cands]


def best(weights: dict, n: int, cands: list) -> list[tuple[int, int, str]]:
    """The highest-scoring set of entities over n tokens. States: the last token is outside (0) or ends an entity (1)."""
    touch = weights.get("touch", 0.0)
    ends = defaultdict(list)
    for c, row in zip(cands, _scores(weights, cands)):
        k = max(range(len(KINDS)), key=row.__getitem__)
        ends[c[1]].append((c[0], row[k], KINDS[k]))
    top = [(0.0, -math.inf)]
    back: list[list] = [[None, None]]
    for j in range(1, n + 1):
        out = max(top[j - 1])
        inside, via = -math.inf, None
        for i, score, kind in ends.get(j, ()):
            before, state = max((top[i][0], 0), (top[i][1] + touch, 1))
            if before + score > inside:
                inside, via = before + score, (i, state, kind)
        back.append([0 if top[j - 1][0] >= top[j - 1][1] else 1, via])
        top.append((out, inside))
    found, j, state = [], n, 0 if top[n][0] >= top[n][1] else 1
    while j:
        if state:
            i, state, kind = back[j][1]
            found.append((i, j, kind))
            j = i
        else:
            state, j = back[j][0], j - 1
    return found[::-1]


def _expected(weights: dict, n: int, cands: list) -> tuple[float, dict]:
    """log Z and the expected features over all ways to choose entities."""
    touch, rows = weights.get("touch", 0.0), _scores(weights, cands)
    ends, starts = defaultdict(list), defaultdict(list)
    for at, (i, j, _) in enumerate(cands):
        ends[j].append(at)
        starts[i].append(at)
    total = [_log_sum(r) for r in rows]
    a = [(0.0, -math.inf)]
    for j in range(1, n + 1):
        inside = -math.inf
        for at in ends[j]:
            o, i = a[cands[at][0]]
            inside = _add(inside, _add(o, i + touch) + total[at])
        a.append((_add(*a[j - 1]), inside))
    b: list = [None] * n + [(0.0, 0.0)]
    for i in range(n - 1, -1, -1):
        out, after = b[i + 1][0], -math.inf
        for at in starts[i]:
            after = _add(after, total[at] + b[cands[at][1]][1])
        b[i] = (_add(out, after), _add(out, after + touch))
    z = _add(*a[n])
    grad: dict = defaultdict(float)
    for at, (i, j, f) in enumerate(cands):
        fresh, touching = a[i][0] + b[j][1] - z, a[i][1] + touch + b[j][1] - z
        grad["touch"] += math.exp(min(touching + total[at], 0.0))
        for k, score in zip(KINDS, rows[at]):
            p = math.exp(min(fresh + score, 0.0)) + math.exp(min(touching + score, 0.0))
            if p > 1e-6:
                for x in f:
                    grad[k, x] += p
    return z, grad


def _log_sum(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs))


def made_sentence(r: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A sentence with entities and with numbers that are none."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))

    def card() -> str:
        body = r.choice("3456") + d(14)
        body += next(x for x in "0123456789" if luhn(body + x))
        return r.choice([body, " ".join(body[i : i + 4] for i in range(0, 16, 4)), "-".join(body[i : i + 4] for i in range(0, 16, 4))])

    def entity() -> tuple[str, str]:
        return r.choice(
            [
                ("email", f"{name()}.{d(2)}@{name()}.{r.choice(['com', 'org', 'net'])}"),
                ("email", f"{name()} (at) {name()} (dot) com"),
                ("email", f"{name()}[at]{name()}[dot]org"),
                ("ip", ".".join(str(r.randint(0, 255)) for _ in range(4))),
                ("card", card()),
                ("phone", f"+{r.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}"),
                ("phone", f"({d(3)}) {d(3)}-{d(4)}"),
                ("phone", f"{d(3)}-{d(3)}-{d(4)}"),
                ("phone", f"+{d(2)} {d(3)} {d(3)} {d(3)}"),
                ("national_id", f"{d(3)}-{d(2)}-{d(4)}"),
            ]
        )

    def other() -> str:
        wrong = r.choice("3456") + d(14)
        wrong += next(x for x in "0123456789" if not luhn(wrong + x))
        return r.choice(
            [
                f"20{d(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
                f"{r.randint(10, 23)}:{d(2)}:{d(2)}",
                wrong,
                d(r.randint(7, 12)),
                f"{d(1)}.{d(8)}",
                f"{d(1)}.{d(1)}.{d(2)}",
                f"{r.randint(256, 999)}.{d(3)}.{r.randint(256, 999)}.{d(2)}",
                f"{d(3)} {d(3)} {d(4)}",
                f"{d(4)}-{d(4)}",
                f"{d(2)}/{d(2)}/{d(4)} {d(2)}:{d(2)}",
                f"{name()}@{name()}",
            ]
        )

    text, gold = "", []
    for _ in range(r.randint(3, 8)):
        pick = r.random()
        if pick < 0.35:
            kind, value = entity()
            if r.random() < 0.3:
                text += r.choice(CUES[kind].split()) + " "
            gold.append((kind, len(text), len(text) + len(value)))
            text += value
        elif pick < 0.6:
            if r.random() < 0.3:
                text += r.choice(CUES["other"].split()) + " "
            text += other()
        else:
            text += name()
        text += r.choice([" ", " ", ", ", ". ", " " + name() + " "])
    return text, gold


@cache
def trained(sentences: int = 700, epochs: int = 5, rate: float = 0.2, decay: float = 1e-4, seed: int = 5) -> dict:
    """Weights by stochastic gradient ascent on the conditional likelihood of made sentences."""
    r = random.Random(seed)
    rows = []
    for _ in range(sentences):
        text, gold = made_sentence(r)
        toks = tokens(text, 0, len(text))
        cands = candidates(text, toks)
        where = {(toks[i][0], toks[j - 1][1]): f for i, j, f in cands}
        right = [(k, where[s, e]) for k, s, e in gold if (s, e) in where]
        rows.append((len(toks), cands, right, sum(e == s2 for (_, _, e), (_, s2, _) in zip(gold, gold[1:]))))
    weights: dict = defaultdict(float)
    for epoch in range(epochs):
        r.shuffle(rows)
        step = rate / (1 + epoch)
        for n, cands, right, touching in rows:
            _, expected = _expected(weights, n, cands)
            for k, f in right:
                for x in f:
                    expected[k, x] -= 1.0
            expected["touch"] -= touching
            for x, g in expected.items():
                weights[x] -= step * (g + decay * weights[x])
    return dict(weights)


def _lead(text: str, start: int) -> int:
    """Where the region of an anchor begins: at the first blank AROUND it, or as far back as an entity with the anchor can reach."""
    lo = max(0, start - AROUND)
    if not lo:
        return 0
    # A blank right before the anchor may be inside an entity.
    if m := _SPACE.search(text, lo, start - 1):
        return m.start()
    far = max(0, start - MOST_CHARS)
    if blanks := [m.start() for m in _SPACE.finditer(text, far, lo)]:
        return blanks[-1]
    return _LETTERS.match(text, far, start).end() if far and text[far - 1].isalpha() else far  # no part of a longer token


def field_spans(text: str, weights: dict) -> list[tuple[str, int, int]]:
    """The field's entities: the text around anchors in regions that end at blanks, each decoded on its own."""
    regions: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        near, hi = m.start() - AROUND, min(len(text), m.end() + AROUND)
        if regions and (near <= regions[-1][1] or _lead(text, m.start()) <= regions[-1][1]):
            regions[-1][1] = hi
        else:
            regions.append([_lead(text, m.start()), hi])
    out = []
    for lo, hi in regions:
        toks = tokens(text, lo, hi)
        out += [(kind, toks[i][0], toks[j - 1][1]) for i, j, kind in best(weights, len(toks), candidates(text, toks))]
    return out


def all_spans(text: str, weights: dict) -> list[tuple[str, int, int]]:
    """Base spans, and those of the field that touch none of them; by kind as listed, then start."""
    spans = base_spans(text)
    taken = sorted((s, e) for _, s, e in spans)
    reach = list(accumulate((e for _, e in taken), max))  # how far the base spans up to each reach
    for kind, s, e in field_spans(text, weights):
        before = bisect.bisect_left(taken, (e, 0))
        if not before or reach[before - 1] <= s:
            spans.append((kind, s, e))
    return sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def find_spans(docs: DataFrame, text: str = "text", weights: dict | None = None) -> DataFrame:
    """docs without its text, with its spans."""
    from pyspark.sql.types import StructType

    common.small_batches(common.session(docs))
    weights = trained() if weights is None else weights
    docs = docs.drop("spans")
    rest = [c for c in docs.columns if c != text]
    # Names that Python workers' columns can't have come back at the end.
    plain = docs.toDF(*("text" if c == text else f"c{i}" for i, c in enumerate(docs.columns)))
    schema = StructType([*(f for f in plain.schema if f.name != "text"), *StructType.fromDDL(f"spans {SPANS}")])

    def found(texts: list[str]) -> dict:
        return {"spans": [[dict(zip(("kind", "start", "end"), x)) for x in all_spans(t, weights)] if _ANCHOR.search(t) else [] for t in texts]}

    return plain.mapInArrow(common.over_texts(found, schema.names[:-1], schema), schema).toDF(*rest, "spans")


def query(spark, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans come from base_spans(), run in the same pass; all spans from the field too."""
    common.small_batches(spark)
    weights = trained()
    schema = f"doc_id bigint, base {SPANS}, spans {SPANS}"

    def found(texts: list[str]) -> dict:
        row = lambda xs: [dict(zip(("kind", "start", "end"), x)) for x in sorted(xs, key=lambda x: (KINDS.index(x[0]), x[1]))]
        some = [bool(_ANCHOR.search(t)) for t in texts]
        return {"base": [row(base_spans(t)) if x else [] for t, x in zip(texts, some)], "spans": [row(all_spans(t, weights)) if x else [] for t, x in zip(texts, some)]}

    docs = common.plain(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    found_rows = docs.mapInArrow(common.over_texts(found, ["doc_id"], schema), schema)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found_rows.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(joined(F.col("base"), BASE_KINDS).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"))
