"""Secret scan: pattern candidates, and a random forest that removes false positives.

Candidates are
* runs of at least `LEAST` characters of `[A-Za-z0-9_+/-]`, with up to two `=` at the end, that hold
  a digit, or a lower-case letter before an upper-case one;
* runs of `SHORT` characters at least in quotes of either kind after an assignment sign;
* values of `SHORT` characters at least after any assignment to a name with a credential word, bare
  (up to a blank, quote, bracket, or one of `<>,;&:=`) or in quotes (up to the same quote, no blanks);
* passwords in the user part of a URL (`user:password@host`);
* PEM blocks as a whole (keys and certificates), with labels of up to 40 signs.
A credential name stands in the 40 signs before the assignment, a user name in front of a password has up to
64; the words beside are those of the 48 signs before and the 32 after. The forest looks at whole values.
Each text is read a fixed number of times, whatever it holds.

The forest looks at length, character classes and transitions, repetition, entropy, coverage by
dictionary words, the path, and the words beside. It learns from labelled findings: a table of
reviewed ones (value, before, after, path, label), or those of `findings.py`, which were written for this
library. `label_findings` is a rule of thumb to pre-label findings for a review; the
forest doesn't learn from it.

A document's secrets are its candidates with a score of at least `limit`. Redaction replaces each
by `mark`. Null and empty texts have no candidates. A null path is an empty one. Without findings of
both kinds the forest gives the share of the label 1, 0 without any. Repeated documents are scanned
alike. Other columns, whatever their names, pass through; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ._common import prepare
from .findings import reviewed_texts

LEAST = 16
SHORT = 8
RUN = r"[A-Za-z0-9_+/\-]"
LONG_RUN = re.compile(rf"(?<!{RUN}){RUN}{{{LEAST},}}+={{0,2}}(?![A-Za-z0-9_+/])")
MIXED = re.compile(r"[0-9]|[a-z][A-Z]")
QUOTED_RUN = re.compile(rf"(?:(?<=[:=][\"'])|(?<=[:=] [\"'])){RUN}{{{SHORT},}}+={{0,2}}(?=[\"'])")
#: The value is looked at only, so that signs inside it are found as well.
ASSIGNED = re.compile(
    rf"[:=][=>]?[ \t]*+(?:(?i:bearer|basic|token)[ \t]++)?(?:(?=\"([^\"\s]{{{SHORT},}}+)\")|(?='([^'\s]{{{SHORT},}}+)')|(?=[\"']?([^\s\"'`<>(){{}}\[\],;&:=]{{{SHORT},}}+(?:={{1,2}}(?![A-Za-z0-9_+/=\-]))?)))"
)
NAMED = re.compile(r"(?i)(?:api_?key|auth|authorization|bearer|credentials?|key|pass|passphrase|passwd|password|private|pwd|secret|token)(?:_\w{0,16}|\d{1,2})?[\"']?[ \t]*$")
USER_PART = re.compile(rf"://[^\s/:@\"'<>]{{0,64}}:(?=([^\s/@\"'<>]{{{SHORT},}}+)@)")
PEM = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]{0,40}-----")
BESIDE = re.compile(r"[^\W\d_]+|[=:\"'(]")
# Words beside which a value is a credential, or none, and forms that credentials have.
CREDENTIAL_WORDS = frozenset("apikey auth authorization bearer credential credentials key pass passphrase passwd password private pwd secret token".split())
OTHER_WORDS = frozenset("archive base blob build card checkout checksum class commit correlation digest etag file hash href id image import index integrity md5 md5sum merge number order path phone png request return rev rsa sha sha256 sha512 url uuid version".split())
KNOWN_FORM = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----(?s:.*)")
PLACEHOLDER = re.compile(r"(?i)example|placeholder|changeme|your|dummy|sample|x{6,}|0{8,}|1234567")
UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
#: A task hands on its word counts when it holds so many words.
WORDS_HELD = 200_000
FINDING = "start int, end int, value string, before string, after string"


def candidates(text: str | None):
    """(start, end, value, words before, words after) of each candidate."""
    if not text:
        return
    spans, begun = [], None
    for m in PEM.finditer(text):
        if m.group(1) == "BEGIN":
            begun = m.start()
        elif begun is not None:
            spans.append((begun, m.end(), False))
            begun = None
    spans += [(*m.span(), False) for m in LONG_RUN.finditer(text) if MIXED.search(m.group())]
    spans += [(*m.span(), False) for m in QUOTED_RUN.finditer(text)]
    for m in ASSIGNED.finditer(text):
        if NAMED.search(text[max(0, m.start() - 40) : m.start()]):
            a, b = m.span(m.lastindex)
            if m.lastindex == 3:
                b = a + max(SHORT, len(m.group(3).rstrip(".")))
            spans.append((a, b, False))
    spans += [(*m.span(1), True) for m in USER_PART.finditer(text)]
    done = 0
    for a, b, user_part in sorted(spans, key=lambda s: (s[0], -s[1], not s[2])):
        if a < done:
            continue
        done = b
        before = BESIDE.findall(text[max(0, a - 48) : a].lower())
        if user_part:  # its place names it
            before += ["password", ":"]
        after = BESIDE.findall(text[b : b + 32].lower())[:3]
        yield a, b, text[a:b], " ".join(before[-5:]), " ".join(after)


def label_findings(value: str, before: str) -> int:
    """1 for a known credential form, or a value of letters and digits that is assigned to a
    credential word and is no placeholder; else 0."""
    if PLACEHOLDER.search(value):
        return 0
    if KNOWN_FORM.fullmatch(value):
        return 1
    words = before.split()
    assigned = any(w in ("=", ":") for w in words) and not CREDENTIAL_WORDS.isdisjoint(words)
    return int(assigned and any(c.isdigit() for c in value) and any(c.isalpha() for c in value))


#: Length of what `finding_features` gives.
WIDTH = 26


def finding_features(value: str, before: str, after: str, path: str | None, dictionary: ahocorasick.Automaton | None) -> list[float]:
    some = value
    kinds = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "s" for c in some]
    n = len(some)
    count = Counter(kinds)
    share = np.array(list(Counter(some).values())) / n
    letters = [c.lower() for c in some if c.isalpha()]
    covered = np.zeros(n, bool)
    if dictionary is not None:
        for end, size in dictionary.iter(some.lower()):
            covered[end - size + 1 : end + 1] = True
    words, following = before.split(), after.split()
    near = [len(words) - i for i, w in enumerate(words) if w in CREDENTIAL_WORDS]
    other = [len(words) - i for i, w in enumerate(words) if w in OTHER_WORDS]
    name = (path or "").lower()
    suffix = name.rpartition(".")[2]
    return [
        float(len(value)),
        count["d"] / n,
        count["l"] / n,
        count["u"] / n,
        count["s"] / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        sum(a == b for a, b in zip(some, some[1:])) / n,
        float(-(share * np.log2(share)).sum()),
        sum(c in "aeiou" for c in letters) / max(1, len(letters)),
        float(all(c in "0123456789abcdefABCDEF" for c in some)),
        covered.sum() / n,
        float(n % 4 == 0),
        float(min(near, default=9)),
        float(min(other, default=9)),
        float("=" in words or ":" in words),
        float(words[-1:] in (["="], [":"])),
        float(words[-1:] in (['"'], ["'"])),
        float("(" in words[-2:]),
        float(following[:1] == ["("]),
        float(following[:1] in (['"'], ["'"])),
        float(KNOWN_FORM.fullmatch(value) is not None),
        float(PLACEHOLDER.search(some) is not None),
        float(UUID.fullmatch(some) is not None),
        float(value.startswith("/") or some.count("/") > 2),
        float(suffix in ("lock", "sum") or "lock" in name),
        float(suffix in ("md", "txt", "rst", "html")),
    ]


class RandomForest:
    """Trees on bootstrap samples; each node tries some features at some cuts (Gini impurity). Of a
    label with less than a share of `rare` of the rows, a sample holds that share."""

    def __init__(self, trees: int = 25, depth: int = 8, least: int = 2, seed: int = 3, rare: float = 0.1):
        self.trees, self.depth, self.least, self.seed, self.rare, self.share = trees, depth, least, seed, rare, 0.0
        self.nodes: list[list[tuple]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "RandomForest":
        self.share = float(y.mean()) if len(y) else 0.0
        if len(y) and 0 < y.sum() < len(y):
            rng = np.random.default_rng(self.seed)
            few = min((np.flatnonzero(y == v) for v in (0.0, 1.0)), key=len)
            for _ in range(self.trees):
                rows = rng.integers(0, len(y), len(y))
                if len(few) < self.rare * len(y):
                    n = int(np.ceil(self.rare * len(y)))
                    rows[:n] = rng.choice(few, n)
                nodes: list[tuple] = []
                self._grow(nodes, x[rows], y[rows], 0, rng)
                self.nodes.append(nodes)
        return self

    def _grow(self, nodes: list, x: np.ndarray, y: np.ndarray, depth: int, rng) -> int:
        at, share = len(nodes), float(y.mean())
        nodes.append((-1, 0.0, share, share))
        if depth == self.depth or len(y) < 2 * self.least or share in (0.0, 1.0):
            return at
        best = (2 * share * (1 - share) - 1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], max(2, int(np.sqrt(x.shape[1])) + 1), replace=False):
            for cut in np.unique(rng.choice(x[:, f], 8)):
                left = x[:, f] <= cut
                n = int(left.sum())
                if self.least <= n <= len(y) - self.least:
                    a, b = y[left].mean(), y[~left].mean()
                    impurity = (n * 2 * a * (1 - a) + (len(y) - n) * 2 * b * (1 - b)) / len(y)
                    best = min(best, (impurity, int(f), float(cut)))
        if best[1] >= 0:
            left = x[:, best[1]] <= best[2]
            low = self._grow(nodes, x[left], y[left], depth + 1, rng)
            high = self._grow(nodes, x[~left], y[~left], depth + 1, rng)
            nodes[at] = (best[1], best[2], low, high)
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.nodes:
            return np.full(len(x), self.share)
        total = np.zeros(len(x))
        for nodes in self.nodes:
            todo = [(0, np.arange(len(x)))]
            while todo:
                at, rows = todo.pop()
                f, cut, low, high = nodes[at]
                if f < 0:
                    total[rows] += low
                elif len(rows):
                    left = x[rows, f] <= cut
                    todo += [(low, rows[left]), (high, rows[~left])]
        return total / len(self.nodes)


class SecretModel:
    """The forest and the dictionary words for coverage."""

    def __init__(self, forest: RandomForest, words: list[str]):
        self.forest, self.words, self.automaton = forest, words, None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def dictionary(self) -> ahocorasick.Automaton | None:
        if self.automaton is None and self.words:
            self.automaton = ahocorasick.Automaton()
            for w in self.words:
                self.automaton.add_word(w, len(w))
            self.automaton.make_automaton()
        return self.automaton

    def scores(self, findings: list[tuple[str, str, str, str | None]]) -> np.ndarray:
        x = [finding_features(*f, self.dictionary()) for f in findings]
        return self.forest.score(np.array(x)) if x else np.zeros(0)


def find_candidates(docs: DataFrame, *, text: str = "text", into: str = "candidates") -> DataFrame:
    """`docs` with an array column of candidates: start, end, value, before, after."""
    prepare(docs.sparkSession)

    @pandas_udf(f"array<struct<{', '.join(f'{n}: {t}' for n, t in (x.split() for x in FINDING.split(', ')))}>>")
    def find(texts: pd.Series) -> pd.Series:
        names = ("start", "end", "value", "before", "after")
        return pd.Series([[dict(zip(names, c)) for c in candidates(t)] for t in texts], dtype=object)

    return docs.withColumn(into, find(F.col(text)))


def document_words(docs: DataFrame, text: str, max_words: int) -> list[str]:
    """The `max_words` words of 4 to 12 letters that most documents hold, over all documents."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for t in batch["t"]:
                seen.update(set(re.findall(r"[^\W\d_]{4,12}", t.lower())))
            if len(seen) > WORDS_HELD:
                yield pd.DataFrame(list(seen.items()), columns=["w", "n"])
                seen.clear()
        if seen:
            yield pd.DataFrame(list(seen.items()), columns=["w", "n"])

    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t"))
    counts = rows.mapInPandas(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return [r.w for r in counts.orderBy(F.desc("n"), "w").limit(max_words).collect()]


def reviewed_findings(lines=None) -> pd.DataFrame:
    """The findings of `findings.py` as value, before, after, path, label; `lines` picks some by line number."""
    found = []
    for number, text, start, end, path, label in reviewed_texts():
        if lines is None or lines(number):
            found += [(v, b, a, path, label) for low, high, v, b, a in candidates(text) if low < end and high > start]
    return pd.DataFrame(found, columns=["value", "before", "after", "path", "label"]).drop_duplicates()


def bounded_findings(findings: DataFrame, max_findings: int) -> pd.DataFrame:
    """At most `max_findings` rows: of each label those of least hash, of label 1 half of them at least
    if there are so many."""
    rows = findings.where("value is not null and value <> '' and label is not null").select(
        "value", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"), F.col("path").cast("string").alias("path"), (F.col("label") > 0).cast("int").alias("label")
    )
    rows = rows.distinct().withColumn("h", F.xxhash64("value", "before", "after", "path"))
    of_label = [rows.where(F.col("label") == y).orderBy("h", "value", "before", "after", "path").limit(max_findings).toPandas() for y in (1, 0)]
    positives = min(len(of_label[0]), max(max_findings // 2, max_findings - len(of_label[1])))
    return pd.concat([of_label[0].head(positives), of_label[1].head(max_findings - positives)])


def train_secret_model(
    docs: DataFrame, findings: DataFrame | None = None, *, text: str = "text", path: str = "source", max_findings: int = 6_000, max_words: int = 3_000
) -> SecretModel:
    """Learns from `findings` (value, before, after, path, label), at most `max_findings` of them; without
    such a table, from the findings that come with the library. The dictionary is the
    `max_words` words that most documents hold.
    """
    prepare(docs.sparkSession)
    model = SecretModel(RandomForest(), document_words(docs, text, max_words))
    table = reviewed_findings() if findings is None else bounded_findings(findings, max_findings)
    return fit_findings(model, table)


def fit_findings(model: SecretModel, table: pd.DataFrame) -> SecretModel:
    table = table.sort_values(["value", "before", "after", "label"])
    x = [finding_features(r.value, r.before, r.after, r.path, model.dictionary()) for r in table.itertuples()]
    model.forest.fit(np.array(x).reshape(len(x), WIDTH), table["label"].to_numpy(dtype=float))
    return model


def scan_secrets(
    docs: DataFrame, model: SecretModel, *, text: str = "text", path: str = "source", limit: float = 0.5, mark: str = "<secret>", into: str = "secrets"
) -> DataFrame:
    """`docs` with a struct column `into`: n_candidates, starts, ends and scores of the secrets, redacted text."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("n_candidates long, starts array<int>, ends array<int>, scores array<double>, redacted string")
    def scan(texts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        owner, spans, found = [], [], []
        for i, (t, p) in enumerate(zip(texts, paths)):
            for a, b, value, before, after in candidates(t):
                owner.append(i)
                spans.append((a, b))
                found.append((value, before, after, p))
        scores = sent.value.scores(found)
        per_text: dict[int, list] = {}
        for i, span, score in zip(owner, spans, scores):
            per_text.setdefault(i, []).append((*span, float(score)))
        rows = []
        for i, t in enumerate(texts):
            all_found = per_text.get(i, [])
            kept = [x for x in all_found if x[2] >= limit]
            redacted = t
            for a, b, _ in reversed(kept):
                redacted = redacted[:a] + mark + redacted[b:]
            rows.append((len(all_found), [x[0] for x in kept], [x[1] for x in kept], [x[2] for x in kept], redacted))
        return pd.DataFrame(rows, columns=["n_candidates", "starts", "ends", "scores", "redacted"], dtype=object)

    return docs.withColumn(into, scan(F.col(text), F.col(path).cast("string")))


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_candidates, n_secrets, starts, ends, score (the highest), redacted_sha256."""
    rows = docs.select("doc_id", "text", "source")
    found = scan_secrets(rows, train_secret_model(rows, **options))
    return found.select(
        "doc_id",
        F.col("secrets.n_candidates").alias("n_candidates"),
        F.size("secrets.starts").cast("long").alias("n_secrets"),
        F.array_join("secrets.starts", ",").alias("starts"),
        F.array_join("secrets.ends", ",").alias("ends"),
        F.array_max("secrets.scores").alias("score"),
        F.sha2(F.coalesce("secrets.redacted", F.lit("")), 256).alias("redacted_sha256"),
    )
