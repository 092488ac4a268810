"""Personal data by candidate gradient boosting, in DataFrame functions throughout.

Base spans are the valid matches of one pattern a kind (email, ip, card, phone),
leftmost and non-overlapping. The patterns are written so that Java's matcher neither
recurses nor tries every start of a long run: their loops are possessive, and a run of
characters is entered at its start or where the last match ended, which leaves the
matches the same.

High-recall generators then propose further, overlapping spans: spelled-out or spaced
addresses, numbers without a country code, grouped or labelled numbers, groups of
hexadecimal digits, and long runs of letters and digits, which may be secrets (tokens,
keys, passwords; a kind without base spans). Each candidate gets features of its format and of the words around
it; boosted trees score it, and it is kept where its calibrated probability reaches the
threshold of its kind and it overlaps no base span (a secret may) nor an earlier kept
span.

The trees are trained once a session on a fixed set of TRAINING templated sentences,
whose features the same expressions compute, and are compiled to CASE expressions:
nothing but built-in functions touches the documents, each row is answered where it is
read, and no row moves. Positions come from the lengths of the pieces between matches,
summed up in groups so that texts with very many matches stay affordable.

Nulls are empty texts. Offsets count code points; ends are exclusive. Rows that repeat
are answered alike. Columns of the input named base or spans, in any case, stay, and
those that find adds get an underscore more; other names are free.
"""

from __future__ import annotations

import string
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name

KINDS = ("email", "ip", "card", "phone")
#: With those that have no base spans.
ALL = (*KINDS, "secret")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}+){1,6}+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}+:){2,7}+(?::?[0-9A-Fa-f]{1,4}+){0,6}+(?![0-9A-Fa-f:])|(?<![0-9])[0-9]{1,3}+(?:\x20?(?:\[\.\]|\(\.\)|\(dot\)|\[dot\])\x20?[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}+(?:[./_\x20-]{1,3}[0-9]{4}+){2,3}+(?:[./_\x20-]{1,3}[0-9]{1,3}+)?+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\([0-9]{2,5}+\)|[0-9]{2,5}+)(?:[./\x20-]{1,2}[0-9]{2,4}+){2,4}+(?![0-9A-Za-z])",
}
#: Characters of secrets, one by one, which Java looks up in a bit set and does not test as ranges.
_RUN = f"[{string.ascii_letters}{string.digits}+/_-]"
LOOSE["secret"] = f"(?<!{_RUN}){_RUN}{{16,200}}+={{0,2}}+(?!{_RUN})"
#: What a text must hold for a generator to be worth running.
HINT = {"email": r"[(\[{]at[)\]}]|\x20@|@\x20|(?:@|\x20at\x20)[A-Za-z0-9-]{1,63}+(?:\x20dot\x20|\x20?[(\[{]dot|\x20\.|\.\x20?[A-Za-z0-9])", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f:]|[0-9]\x20?[(\[](?:\.|dot)", "card": r"[0-9]{4}[./_\x20-]{1,3}[0-9]{4}", "phone": r"[0-9][)./\x20-]{1,2}[0-9]{2}", "secret": f"{_RUN}{{16}}"}
WORDS = {
    "email": r"(?i)\b(?:e-?mail|mail|correo|courriel|contact|write|reach|kontakt)\b",
    "ip": r"(?i)\b(?:ip|ipv[46]|host|server|address|gateway|client|dns)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|tarjeta|carte|karte|kreditkarte)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|sms|telefon|telefono|téléphone|handy|movil)\b",
    "secret": r"(?i)(?:\b|_)(?:token|secret|pass(?:word|wd|phrase)?|pwd|key|apikey|bearer|auth|authorization|credentials?|passwort|contraseña)\b",
    "other": r"(?i)\b(?:version|isbn|issn|order|invoice|section|page|pages|date|time|score|serial|ratio|build|chapter|ref|years?|from|commit|sha|sha1|sha256|md5|checksum|hash|uuid|id)\b",
}
#: Code points before and after a candidate that count as its context.
CONTEXT = 28
TRAINING, HELD = 4000, 3
GROUP = 256


def _positions(text: Column, pattern: str, hint: str | None = None) -> Column:
    """array<struct<s, e, t>>: start, end and text of all matches of the pattern."""
    p = F.lit(pattern)
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0))
    pairs = F.arrays_zip(F.transform(gaps, lambda g: F.length(g)).alias("g"), found.alias("t"))
    none = F.array().cast("array<struct<s:int,e:int,t:string>>")

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + F.length(x["t"])
        return F.struct(e.alias("at"), F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e"), x["t"].alias("t"))).alias("out"))

    def group(acc: Column, k: Column) -> Column:
        part = F.filter(F.slice(acc["all"], k * GROUP + 1, GROUP), lambda x: x["t"].isNotNull())
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.struct(inner["at"].alias("at"), F.array_append(acc["out"], inner["out"]).alias("out"), acc["all"].alias("all"))

    groups = F.sequence(F.lit(0), F.floor(F.size(pairs) / GROUP).cast("int"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<s:int,e:int,t:string>>>").alias("out"), pairs.alias("all"))
    made = F.aggregate(groups, zero, group, lambda acc: F.flatten(acc["out"]))
    seen = text.contains(hint) if hint == "@" else text.rlike(hint or pattern)
    return F.when(F.coalesce(seen, F.lit(False)), made).otherwise(none)


def _valid(kind: str, t: Column) -> Column:
    digits = F.regexp_replace(t, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return t.rlike(r"^(?:0*+(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5]|(?<=0))(?:\.|$)){4}$")
    if kind == "card":
        return n.between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _span(kind: str, x: Column) -> Column:
    return F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"))


def base_spans(text: Column) -> dict[str, Column]:
    """Valid base spans of each kind as array<struct<s, k, e>>, k the kind's place in KINDS."""
    hints = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
    return {k: F.transform(F.filter(_positions(text, p, hints[k]), lambda x: _valid(k, x["t"])), lambda x: _span(k, x)) for k, p in BASE.items()}


FEATURES = ("kind", "length", "digits", "letters", "separators", "groups", "luhn", "spelled", "bracket", "colons", "tld", "own_word", "other_word", "near_word", "before", "after", "plus", "rest")


def _features(kind: str, text: Column, x: Column) -> Column:
    """The numbers that the trees see of a candidate, in the order of FEATURES."""
    t = x["t"]
    lead = F.substring(text, F.greatest(F.lit(1), x["s"] + 1 - CONTEXT), F.least(x["s"], F.lit(CONTEXT)))
    tail = F.substring(text, x["e"] + 1, F.lit(CONTEXT))
    digits = F.regexp_replace(t, "[^0-9]", "")
    last = F.substring(lead, F.length(lead), F.lit(1))
    nxt = F.substring(tail, 1, 1)
    form = lambda c: F.when(c == "", 0).when(c.rlike(r"[\s]"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike("[A-Za-z]"), 3).when(c.rlike(r"[:=(<\[\"']"), 4).otherwise(5)
    return F.array(*[c.cast("double") for c in (
        F.lit(ALL.index(kind)), F.length(t), F.length(digits), F.length(F.regexp_replace(t, "[^A-Za-z]", "")), F.length(F.regexp_replace(t, "[A-Za-z0-9]", "")),
        F.size(F.split(t, "[^A-Za-z0-9]+")), F.coalesce(F.call_function("luhn_check", digits), F.lit(False)), t.rlike(r"(?i)\bat\b|\bdot\b"), t.rlike(r"[(\[{]"), F.length(F.regexp_replace(t, "[^:]", "")),
        t.rlike(r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"), lead.rlike(WORDS[kind]), lead.rlike(WORDS["other"]), tail.rlike(WORDS[kind]), form(last), form(nxt), last == "+",
        F.size(F.filter(F.split(lead, r"\s+"), lambda w: w.rlike("[0-9]"))),
    )])


def candidates(text: Column, base: dict[str, Column]) -> dict[str, Column]:
    """Proposed spans with features, array<struct<s, e, t, f>> a kind, without those that a base span of the kind equals, and without secrets of letters or digits alone."""
    fresh = lambda k, x: ~F.exists(base[k], lambda b: (b["s"] == x["s"]) & (b["e"] == x["e"])) if k in base else x["t"].rlike("[0-9]") & x["t"].rlike("[A-Za-z]")
    return {k: F.transform(F.filter(_positions(text, p, HINT[k]), lambda x: fresh(k, x)), lambda x: F.struct(x["s"], x["e"], x["t"], _features(k, text, x).alias("f"))) for k, p in LOOSE.items()}


def training(spark: SparkSession, n: int = TRAINING) -> DataFrame:
    """(id, kind, y, text): templated sentences with one candidate of their kind each, personal (y = 1) or merely alike."""
    i = F.col("id")
    r = lambda salt, m: F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(m)).cast("int")
    pick = lambda salt, *xs: F.get(F.array(*[F.lit(x) for x in xs]), r(salt, len(xs)))
    num = lambda salt, width: F.lpad(F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(10**width)).cast("string"), width, "0")
    hexa = lambda salt: F.lower(F.hex(r(salt, 65536)))
    word = lambda salt: pick(salt, "the", "rain", "then", "alors", "und", "with", "pour", "casa", "left", "over", "onto", "mit", "gray", "stone", "river")
    name = F.concat(pick("n1", "ana", "joe", "lee", "kim", "max", "eva"), pick("n2", ".", "_", ""), pick("n3", "smith", "diaz", "roy", "king", "berg"))
    at, dot = pick("at", " at ", " (at) ", " [at] ", "(at)", "[at]", " @ "), pick("dot", " dot ", " (dot) ", "[dot]", " . ", ".")
    host = pick("h", "mail", "example", "corp", "uni", "post")
    sep = pick("sep", "-", ".", " ", "/")
    part = lambda k: r(f"i{k}", 256) % F.get(F.array(F.lit(10), F.lit(100), F.lit(256)), r(f"j{k}", 3))
    four = F.call_function("concat_ws", pick("s4", ".", "/", "_", "  ", "-"), num("c1", 4), num("c2", 4), num("c3", 4), num("c4", 4))
    context = {
        "email": pick("ce", "email me: ", "contact ", "reach me via mail ", "e-mail = ", "write to "), "ip": pick("ci", "server ip ", "host address ", "client ip: ", "gateway "),
        "card": pick("cc", "card number ", "visa ", "credit card: ", "my card is "), "phone": pick("cp", "call ", "phone: ", "tel. ", "mobile ", "fax "),
        "secret": F.concat(pick("cs", "token", "api_key", "password", "secret", "auth", "access key", "TOKEN", "Key"), pick("eq", " = ", "=", ": ", " "), pick("qu", '"', "'", "")),
    }
    digest = F.sha2(F.concat(i.cast("string"), F.lit("s")), 256)
    mixed = F.base64(F.unhex(digest))
    random = F.when(r("form", 3) == 0, F.substring(digest, F.lit(1), r("len", 40) + 24)).when(r("form", 3) == 1, F.upper(F.substring(digest, F.lit(1), r("len", 40) + 24))).otherwise(F.substring(mixed, F.lit(1), r("len", 20) + 20))
    yes = {
        "email": F.concat(name, at, host, dot, pick("tld", "com", "org", "net", "de", "fr")),
        "ip": F.when(r("v", 2) == 0, F.concat_ws("[.]", *[part(k) for k in range(4)])).otherwise(F.concat_ws(":", *[hexa(f"x{k}") for k in range(8)])),
        "card": four, "phone": F.concat(F.lit("("), num("p1", 3), F.lit(") "), num("p2", 3), sep, num("p3", 4)), "secret": random,
    }
    no = {
        "email": F.concat(word("w1"), F.lit(" at "), word("w2"), F.lit(" dot "), word("w3")),
        "ip": F.concat_ws(":", r("t1", 24), r("t2", 60) + 10, r("t3", 60) + 10),
        "card": four, "phone": F.call_function("concat_ws", sep, r("d1", 20) + 10, r("d2", 20) + 10, r("d3", 90) + 10, num("d4", 2)),
        "secret": F.concat_ws("-", word("w4"), word("w5"), word("w6"), num("s1", 4), word("w7")),
    }
    plain = pick("po", "version ", "order ", "ref ", "serial ", "invoice ", "on page ", "commit ", "sha256 ")
    neutral = F.concat(word("l1"), F.lit(" "), word("l2"), F.lit(" "))
    kind, y = r("kind", len(ALL)), (r("y", 2) == 0)
    parts = []
    for k, x in enumerate(ALL):  # a frame a kind, which keeps the generated code short
        # a personal form stands by a word of its kind nearly always; without one, or by another word, it proves nothing
        personal = F.concat(neutral, context[x], yes[x], F.lit(" "), word("l3"))
        alike = F.when(r("m", 4) == 0, F.concat(neutral, yes[x], F.lit(" "), word("l3"))).when(r("m", 4) == 1, F.concat(neutral, plain, yes[x], F.lit(" "), word("l3"))).when(r("m", 4) == 2, F.concat(neutral, plain, no[x], F.lit(" "), word("l3"))).otherwise(F.concat(neutral, no[x], F.lit(" "), word("l3")))
        parts.append(spark.range(0, n, 1, 1).where(kind == k).select("id", kind.alias("kind"), y.cast("int").alias("y"), F.when(y, personal).otherwise(alike).alias("text")))
    return reduce(DataFrame.unionByName, parts)


class Boosted:
    """Gradient-boosted trees of depth 2 on the logistic loss, with a calibrated threshold for each kind."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, rounds: int = 24, rate: float = 0.3, precision: float = 0.99) -> None:
        self.trees: list[tuple] = []
        self.rate = rate
        tx, ty = x[~held], y[~held]
        self.start = float(np.log((ty.mean() + 1e-3) / (1 - ty.mean() + 1e-3)))
        z = np.full(len(ty), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z))
            tree = self._grow(tx, ty - p, p * (1 - p), np.arange(len(ty)), 2)
            self.trees.append(tree)
            z += rate * self._walk(tree, tx)
        zh, yh, kind = self.raw(x[held]), y[held], x[held, 0]
        # calibration: a logistic curve through held-out scores
        a = np.array([1.0, 0.0])
        u = np.stack([zh, np.ones(len(zh))], axis=1)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(u @ a, -30, 30)))
            a = a - np.linalg.solve((u * (p * (1 - p))[:, None]).T @ u + np.eye(2) * 1e-2, u.T @ (p - yh) + 1e-2 * (a - [1.0, 0.0]))
        self.scale, self.shift = map(float, a)
        ph = 1 / (1 + np.exp(-np.clip(self.scale * zh + self.shift, -30, 30)))
        self.threshold = []
        for k in range(len(ALL)):
            q, t = ph[kind == k], yh[kind == k]
            order = np.argsort(-q)
            s = np.r_[q[order], 0.0]
            good = np.cumsum(t[order]) / np.arange(1, len(q) + 1)
            # equal scores stand or fall together; the threshold lies half-way to the next score below
            ok = np.flatnonzero((good >= precision) & (s[:-1] >= 0.5) & (s[:-1] > s[1:]))
            self.threshold.append(float(max(0.5, (s[ok[-1]] + s[ok[-1] + 1]) / 2)) if len(ok) else 2.0)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, depth: int) -> tuple:
        leaf = (float(g[at].sum() / (h[at].sum() + 1.0)),)
        if not depth or len(at) < 20:
            return leaf
        best = (1e-6, 0, 0.0)
        whole = g[at].sum() ** 2 / (h[at].sum() + 1)
        for f in range(x.shape[1]):
            order = at[np.argsort(x[at, f], kind="stable")]
            v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if len(cut):
                gain = gs[cut] ** 2 / (hs[cut] + 1) + (gs[-1] - gs[cut]) ** 2 / (hs[-1] - hs[cut] + 1) - whole
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if best[0] <= 1e-6:
            return leaf
        left = x[at, best[1]] <= best[2]
        return best[1], best[2], self._grow(x, g, h, at[left], depth - 1), self._grow(x, g, h, at[~left], depth - 1)

    def _walk(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(x), tree[0])
        f, cut, a, b = tree
        return np.where(x[:, f] <= cut, self._walk(a, x), self._walk(b, x))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum(self._walk(t, x) for t in self.trees)

    def sql(self, f: str) -> str:
        """The raw score as an expression over an array of features."""
        def case(tree: tuple) -> str:
            if len(tree) == 1:
                return f"{tree[0] * self.rate:.9g}D"
            return f"if({f}[{tree[0]}] <= {tree[1]:.9g}D, {case(tree[2])}, {case(tree[3])})"

        return " + ".join([f"{self.start:.9g}D", *map(case, self.trees)])


_fitted: dict[str, Boosted] = {}


def _propose(rows: DataFrame, whole: Column) -> DataFrame:
    """rows with base (sorted spans) and found (candidates with features) added, under names that are free. Base spans are
    columns of their own, used twice, so the optimiser does not copy them into the candidates' loops."""
    named = {k: free_name(rows, f"base_{k}") for k in KINDS}
    all_base, all_found = added(rows)[0], free_name(rows, "found")
    rows = rows.withColumns({named[k]: c for k, c in base_spans(whole).items()})
    base = {k: F.col(named[k]) for k in KINDS}
    found = []
    for number, (_, c) in enumerate(candidates(whole, base).items()):
        found.append(F.transform(c, lambda x: F.struct(x["s"].alias("s"), F.lit(number).alias("k"), x["e"].alias("e"), x["f"].alias("f"))))
    return rows.withColumns({all_base: F.array_sort(F.concat(*base.values())), all_found: F.concat(*found)})


def model(spark: SparkSession) -> Boosted:
    """The trees, fitted on the first call in a process."""
    if "model" not in _fitted:
        rows = training(spark).repartition(4, "id")  # made once: the text is no expression to be copied below
        made = _propose(rows, F.col("text")).select("id", "kind", "y", F.transform("found", lambda x: x["f"]).alias("fs")).toArrow()
        # a candidate of another kind than its sentence's is nothing personal
        got = sorted((i, f, y * (f[0] == kind)) for i, kind, y, fs in zip(*(made[c].to_pylist() for c in ("id", "kind", "y", "fs")), strict=True) for f in fs)
        ids, x, y = (np.array(c, float) for c in zip(*got, strict=True))
        _fitted["model"] = Boosted(x, y, ids % HELD == 0)
    return _fitted["model"]


def added(documents: DataFrame) -> tuple[str, str]:
    """The names of the columns that find adds to a frame."""
    return free_name(documents, "base"), free_name(documents, "spans")


def find(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with base and spans added: sorted arrays of struct<s, k, e>, the base ones and all of them."""
    base, spans = added(documents)
    found, last = free_name(documents, "found"), free_name(documents, "kept")
    m = model(documents.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = _propose(documents, whole)
    limits = " ".join(f"when x.k = {k} then {float(np.log(t / (1 - t)) if t < 1 else np.inf) if t < 1 else 1e300:.9g}D" for k, t in enumerate(m.threshold))
    kept = F.expr(f"filter(`{found}`, x -> {m.scale:.9g}D * ({m.sql('x.f')}) + {m.shift:.9g}D >= case {limits} end and (x.k >= {len(KINDS)} or not exists(`{base}`, b -> b.s < x.e and x.s < b.e)))")
    rows = rows.withColumn(last, F.when(F.size(found) > 0, F.array_sort(F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))).otherwise(F.array().cast("array<struct<s:int,k:int,e:int>>")))
    # of spans that overlap, the earlier stays
    apart = F.aggregate(last, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,k:int,e:int>>").alias("out")), lambda a, x: F.when(x["s"] >= a["at"], F.struct(x["e"].alias("at"), F.array_append(a["out"], x).alias("out"))).otherwise(a), lambda a: a["out"])
    return rows.withColumn(spans, F.when(F.size(last) == 0, F.col(base)).otherwise(F.array_sort(F.concat(base, apart)))).select(*documents.columns, base, spans)


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ALL])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def redact(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with every span, overlapping ones united, replaced by its kind in brackets."""
    rows = find(documents, text)
    names = F.array(*[F.lit(f"[{k}]") for k in ALL])
    t = F.col(text)

    def step(a: Column, x: Column) -> Column:
        inside = x["s"] < a["at"]
        gap = F.substring(t, a["at"] + 1, F.greatest(F.lit(0), x["s"] - a["at"]))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(inside, a["out"]).otherwise(F.concat(a["out"], gap, F.get(names, x["k"]))).alias("out"))

    spans = added(documents)[1]
    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    return rows.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(t)).select(*documents.columns)


def digest(documents: DataFrame) -> DataFrame:
    """The contract of op1; its spans are of the four kinds. n_found counts all spans, secrets too."""
    rows = find(documents.select("doc_id", "text"))
    personal = F.filter("spans", lambda x: x["k"] < len(KINDS))
    counts = [F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(len(KINDS))]
    return rows.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(personal).alias("spans"), written(F.filter("spans", lambda x: x["k"] >= len(KINDS))).alias("secrets"), F.size("spans").cast("long").alias("n_found"))
