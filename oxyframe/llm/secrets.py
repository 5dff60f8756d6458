"""Secret scan: native candidate search, and a random forest that removes false positives.

Candidates, their features and the forest's votes are SQL expressions, so texts stay
in the JVM and nothing is shuffled. A word (between blanks) is cut into runs of
characters that values have; a run long enough, with a digit or a telling neighbour,
is a candidate. Its features are its length, shares of character classes, class
transitions, distinct characters, share covered by dictionary words, shapes (hex,
UUID, known prefixes, placeholders), path signs, the signs at both its ends, the runs
and words before and after it, and the document's path. The forest is trained on
labelled findings: by default lines made from rules with a fixed seed, or the
caller's own. Training data are bounded by the caller's list; the fitted forest is a
literal of the query.

Patterns repeat classes of single characters only, and possessively or up to a
bound, so time and stack do not grow with the square or depth of a match: lines and
words of any length are scanned whole, in time and memory linear in the line.

Edge cases: null and empty texts have no candidates. Private-key headers are found
without a vote. "=" never belongs to a value, so a base64 value is found without its
padding. Null and repeated ids give their rows. Other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import json
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TREES, DEPTH = 15, 5
MIN_LENGTH, MIN_KEYED = 12, 8

# Words that make identifiers and prose, not keys.
DICTIONARY = (
    "about account address admin after again always application array async author back base batch before begin between block body branch buffer build button cache call card case "
    "change channel check class client close cluster code color column command comment commit common compare compile config connect const content context control copy count country "
    "create custom data database date debug default delete deploy detail device direct directory document domain download driver email enable encode error event example execute "
    "export factory field file filter final first folder format frame from function generate global group handle header helper home host image import index input install instance "
    "integer interface internal item java joined kernel label language last layout length level library license limit line link list load local location lock login machine main "
    "manager master match memory message method model module month name network node number object offset open option order output package page param parent parse path pattern "
    "place plain plugin point policy port print process product profile project property protocol public query queue random range read record region release remove report request "
    "resource response result return root route sample schema screen script search section select server service session setting simple size snapshot source stack start state "
    "static status storage store stream string style submit summary support switch system table target task template test text thread time title type update upload user util value "
    "variable version view window word work world write"
).split()
# Neighbours that speak for and against a secret.
TELLING = r"(?i)(passw(or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|bearer|client[_-]?secret)"
BENIGN = r"(?i)(commit|sha-?1|sha-?256|md5|checksum|digest|uuid|guid|hash|etag|build|version|revision|example|dummy|sample|placeholder|fixture|import|include|href|src)"
PLACEHOLDER = r"(?i)(example|changeme|placeholder|your[_-]|dummy|redacted|x{4}|\*{4}|0{6}|123456|abcdef)"
PREFIX = r"^(AKIA|ASIA|ghp_|gho_|ghs_|xox[abps]-|sk_live_|rk_live_|AIza|eyJ|glpat-|npm_)"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
KINDS = {
    "aws_access_key": r"^(AKIA|ASIA)[0-9A-Z]{16}$",
    "github_token": r"^gh[pos]_[0-9A-Za-z]{36}",
    "slack_token": r"^xox[abps]-",
    "jwt": r"^eyJ[0-9A-Za-z_-]+\.",
    "stripe_key": r"^[rs]k_live_",
    "google_api_key": r"^AIza[0-9A-Za-z_-]{35}$",
}
RUN = r"[A-Za-z0-9+/_.~!$%^*-]++"
KEY_HEADER = r"-----BEGIN [A-Z0-9 ]{0,64}PRIVATE KEY"
# A line without a digit and without these has no candidate.
_HINTS = ("passw", "pwd", "secret", "token", "api", "access", "auth", "credential", "private", "bearer")
_ASKS = "line rlike '[0-9]' or exists(array(lower(line)), x -> " + " or ".join(f"contains(x, '{h}')" for h in _HINTS) + ")"

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "length(v)",
    f"1 - length(translate(v, '{_DIGITS}', '')) / length(v)",
    f"1 - length(translate(v, '{_UPPER}', '')) / length(v)",
    f"1 - length(translate(v, '{_LOWER}', '')) / length(v)",
    f"length(translate(v, '{_DIGITS}{_UPPER}{_LOWER}', '')) / length(v)",
    f"length(regexp_replace(translate(v, '+/_.~!$%^*-{_DIGITS}{_UPPER}{_LOWER}', '{'#' * 11}{'0' * 10}{'U' * 26}{'l' * 26}'), '(.)\\\\1++', '$1')) / length(v)",
    "size(array_distinct(split(v, ''))) / length(v)",
    "1 - length(regexp_replace(lower(v), '" + "|".join(DICTIONARY) + "', '')) / length(v)",
    "1 - length(translate(v, 'aeiouAEIOU', '')) / length(v)",
    "int(v rlike '^[0-9a-fA-F]+$')",
    "int(v rlike '{UUID}')",
    "int(v rlike '{PREFIX}')",
    "int(v rlike '{PLACEHOLDER}')",
    "int(v rlike '/|[.](py|js|java|md|txt|html|json|xml|csv|png|jpg|so|jar|cfg|yml|yaml)$' or v rlike '^[0-9]++[.][0-9]')",
    "int(telling)",
    "int(benign)",
    "int(s0 rlike '[=:]')",
    "int(s1 rlike '^[=:]')",
    "int(s1 like '@%')",
    "int(s0 like '%:' and a1 like '//%' and s1 like '@%')",
    "int(path rlike '(?i)(test|spec|example|fixture|mock|docs?)')",
)


def _sql(text: str) -> str:
    for name, pattern in (("UUID", UUID), ("PREFIX", PREFIX), ("PLACEHOLDER", PLACEHOLDER), ("TELLING", TELLING), ("BENIGN", BENIGN)):
        text = text.replace("{" + name + "}", pattern.replace("\\", "\\\\"))
    return text


def candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, line_no, word_no (in the line, from 1), kind, v and features ``f`` of each candidate.

    ``path`` names a column with the document's path.
    """
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    tell = _sql("{TELLING}")
    harm = _sql("{BENIGN}")
    # Outer generators: for inner ones the optimizer would add a filter that evaluates their whole input again.
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), where.alias("path"), F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line")).where(_ASKS)
    # Of a word's neighbours only flags go on, so that a long one is not copied for each candidate.
    split = lines.selectExpr("doc_id", "path", "line_no", "split(line, '[ \\\\t\\\\r]') as ws", f"line rlike '{tell}' as asks")
    flagged = split.selectExpr("doc_id", "path", "line_no", "ws", "asks", "transform(ws, (x, i) -> named_struct('w', x, 'i', i)) as words", f"if(asks, concat(array(false, false, false), transform(ws, x -> x rlike '{tell}')), array()) as t")
    long = flagged.selectExpr("doc_id", "path", "line_no", "ws", "asks", "t", f"filter(words, z -> length(z.w) >= {MIN_KEYED} and ((asks and (t[z.i] or t[z.i + 1] or t[z.i + 2] or t[z.i + 3])) or z.w rlike '[0-9]')) as words")
    begun = long.selectExpr(
        "doc_id", "path", "line_no",
        "transform(words, z -> named_struct('word_no', z.i + 1, 'w', z.w, 'tell', asks and (t[z.i] or t[z.i + 1] or t[z.i + 2]),"
        f" 'harm', concat_ws(' ', get(ws, z.i - 3), get(ws, z.i - 2), get(ws, z.i - 1), get(ws, z.i + 1)) rlike '{harm}')) as found",
    )
    word = begun.selectExpr("doc_id", "path", "line_no", "inline_outer(found)").where("w is not null")
    cut = word.withColumn("v", F.regexp_extract_all("w", F.lit(RUN), F.lit(0))).withColumn("s", F.split("w", RUN))
    beside = cut.selectExpr(
        "doc_id", "path", "line_no", "word_no", "tell", "harm", "v",
        "concat(array(''), v) as a1", "concat(array('', ''), v) as a2", "concat(slice(v, 2, size(v)), array('')) as b1",
        "transform(s, x -> right(x, 4)) as s0", "transform(slice(s, 2, size(s)), x -> left(x, 4)) as s1",
    )
    runs = beside.selectExpr("doc_id", "path", "line_no", "word_no", "tell", "harm", f"filter(arrays_zip(v, a1, a2, b1, s0, s1), z -> length(z.v) >= {MIN_KEYED}) as zipped")
    each = runs.selectExpr("doc_id", "path", "line_no", "word_no", "tell", "harm", "inline_outer(zipped)").where("v is not null")
    valued = each.selectExpr(
        "doc_id", "path", "line_no", "word_no", "v like '//%' and s0 like '%:' as host", "trim(BOTH '.!*~^' FROM if(v like '//%' and s0 like '%:', substring(v, 3), v)) as v", "a1", "b1", "s0", "s1",
        f"tell or concat_ws(' ', a2, a1) rlike '{tell}' as telling", f"harm or concat_ws(' ', a2, a1, b1) rlike '{harm}' as benign", "concat_ws(' ', a2, a1) rlike '(?i)passw|pwd' as pass",
    )
    # A name before "@" and a domain is a mail address, unless a URL has it or a neighbour tells.
    kept = valued.where("not (s1 like '@%' and b1 like '%.%') or telling or host or (s0 like '%:' and a1 like '//%')").where(f"v rlike '[A-Za-z]' and ((length(v) >= {MIN_LENGTH} and v rlike '[0-9]') or (length(v) >= {MIN_KEYED} and telling))")
    kind = F.when(F.lit(False), "")
    for name, pattern in KINDS.items():
        kind = kind.when(F.col("v").rlike(pattern), name)
    kind = kind.when(F.col("pass"), "password").otherwise("token")
    return kept.withColumn("kind", kind).selectExpr("doc_id", "line_no", "word_no", "kind", "v", "array(" + ", ".join(f"cast({_sql(f)} as double)" for f in FEATURES) + ") as f")


def labelled_findings(n: int = 2400, seed: int = 11) -> list[tuple[str, int, str]]:
    """Lines with one candidate each, whether it is a secret, and the path; made from rules.

    A password or token found in tests, fixtures or examples is harmless, the same one elsewhere is not.
    """
    rng = random.Random(seed)
    hexa, alnum, upper, b64 = "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    some = lambda abc, a, b=None: "".join(rng.choice(abc) for _ in range(rng.randint(a, b or a)))
    word = lambda: rng.choice(DICTIONARY) if rng.random() < 0.5 else some("abcdefghijklmnopqrstuvwxyz", 2, 9)
    uuid = lambda: "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12))
    secret = [
        lambda: "AKIA" + some(upper, 16),
        lambda: "ASIA" + some(upper, 16),
        lambda: f'token = "{some(hexa, 32, 48)}"',
        lambda: f"password={some(hexa, 10, 24)}",
        lambda: f"{rng.choice(['password', 'passwd', 'pwd', 'secret'])}{rng.choice(['=', ': '])}{some(alnum + '!$%', 9, 20)}1",
        lambda: f"api_key{rng.choice(['=', ': ', ' = '])}{some(alnum, 20, 40)}",
        lambda: f'"client_secret": "{some(alnum, 24, 40)}"',
        lambda: f"Authorization: Bearer {some(alnum + '-_', 30, 60)}7",
        lambda: "ghp_" + some(alnum, 36),
        lambda: f"xoxb-{some('0123456789', 11)}-{some(alnum, 24)}",
        lambda: "sk_live_" + some(alnum, 24),
        lambda: "AIza" + some(alnum, 35),
        lambda: f"eyJ{some(alnum, 20)}.eyJ{some(alnum, 40)}.{some(alnum, 43)}",
        lambda: f"aws_secret_access_key = {some(b64, 39)}7",
        lambda: f"{rng.choice(['postgres', 'mysql', 'amqp', 'https'])}://{word()}:{some(rng.choice((alnum, hexa)), 10, 24)}3@{word()}.{word()}/{word()}",
        lambda: f"https://{word()}.io/{word()}?{rng.choice(['api_key', 'token', 'access_token'])}={some(rng.choice((alnum, hexa)), 16, 40)}5",
        lambda: f'{{"{word()}":"{word()}","{rng.choice(["password", "secret", "token"])}":"{some(rng.choice((alnum, hexa)), 12, 32)}4"}}',
    ]
    harmless = [
        lambda: f"commit {some(hexa, 40)}",
        lambda: f"md5 checksum {some(hexa, 32)}",
        lambda: f"sha256:{some(hexa, 64)}",
        lambda: f"uuid {uuid()}",
        uuid,
        lambda: f"session {uuid()}",
        lambda: "AKIA" + "EXAMPLE" + some("0123456789", 9),
        lambda: f"password={rng.choice(['changeme123', 'your_password1', 'placeholder1', 'dummy-password1', 'xxxxxxxx12', 'example1234'])}",
        lambda: f"token = your_token_here_{rng.randint(1, 9)}",
        lambda: f"api_key: {'x' * rng.randint(12, 30)}0",
        lambda: "/".join(rng.choice(DICTIONARY) for _ in range(4)) + f"{rng.randint(1, 99)}.py",
        lambda: "http://" + rng.choice(DICTIONARY) + ".example.com/" + some(hexa, 12),
        lambda: "".join(w.title() for w in rng.sample(DICTIONARY, 3)) + str(rng.randint(1, 99)),
        lambda: "_".join(rng.sample(DICTIONARY, 3)) + str(rng.randint(1, 99)),
        lambda: f"password_{rng.choice(DICTIONARY)}_{rng.choice(DICTIONARY)}2",
        lambda: f"version {rng.randint(0, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 99)}-{rng.choice(DICTIONARY)}{some('0123456789', 8)}",
        lambda: f"{rng.choice(DICTIONARY)}-{rng.choice(DICTIONARY)}-{some('0123456789', 4, 8)}",
        lambda: f"tokenizer {rng.choice(DICTIONARY)}_{rng.choice(DICTIONARY)}_{rng.randint(1, 64)}",
        lambda: some("aeiou" * 2 + "nrst", 14, 22) + rng.choice("0123456789"),
        lambda: f"mail {word()}.{word()}{rng.randint(1950, 2010)}@mail.{word()}.com",
        lambda: f"https://{word()}.org/{word()}/{word()}?id={some('0123456789', 4)}&page={word()}_{word()}{rng.randint(1, 99)}",
        lambda: f"{word()}({rng.choice(DICTIONARY)}_{rng.choice(DICTIONARY)}_{rng.choice(DICTIONARY)}{rng.randint(1, 9)}=",
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}",
        lambda: f"token_{rng.choice(DICTIONARY)} = {rng.choice(DICTIONARY)}.{rng.choice(DICTIONARY)}_{rng.choice(DICTIONARY)}",
        lambda: f"#{some(hexa, 6)}-{some(hexa, 6)}-{rng.choice(DICTIONARY)}",
        lambda: f"{rng.choice(['chr', 'isbn', 'doi', 'rs'])}{some('0123456789', 2)}-{some('0123456789', 4, 7)}-{some('0123456789', 2)}",
    ]
    weak = secret[2:7]  # shapes that test data have too
    folder = lambda names: "/".join([rng.choice(DICTIONARY), rng.choice(names), rng.choice(DICTIONARY) + rng.choice((".py", ".md", ".yml", ""))])
    out = []
    for i in range(n):
        label, kind = int(i % 2 == 0), rng.random()
        core = rng.choice(secret if label else harmless)()
        path = "" if kind < 0.4 else folder(("src", "deploy", "lib", "config"))
        if not label and kind > 0.75:
            core, path = rng.choice(weak)(), folder(("tests", "fixtures", "examples", "docs"))
        if rng.random() < 0.15:
            core = rng.choice(('f("{}")', "({}),", "a,b,{};", "[{}]", "<{}>", "'{}':")).format(core)
        out.append((" ".join([word() for _ in range(rng.randint(0, 5))] + [core] + [word() for _ in range(rng.randint(0, 5))]), label, path))
    return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> list[tuple[list[int], list[float], list[float]]]:
    """Random forest of complete trees: features and thresholds of the inner nodes, and the leaves' share of secrets."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        feature, cut, leaf = [0] * (2**depth - 1), [0.0] * (2**depth - 1), [0.5] * 2**depth
        parts = {1: rows}
        for node in range(1, 2**depth):
            own = parts.pop(node)
            best = (np.inf, 0, np.inf)
            share = y[own].mean() if len(own) else 0.5
            if len(own) > 4 and 0 < share < 1:
                for k in rng.choice(x.shape[1], 5, replace=False):
                    order = np.argsort(x[own, k], kind="stable")
                    v, t = x[own, k][order], y[own][order]
                    left = np.cumsum(t)[:-1]
                    n = np.arange(1, len(v))
                    gini = left * (1 - left / n) + (t.sum() - left) * (1 - (t.sum() - left) / (len(v) - n))
                    gini[v[1:] == v[:-1]] = np.inf
                    j = int(gini.argmin())
                    if gini[j] < best[0]:
                        best = (gini[j], int(k), float((v[j] + v[j + 1]) / 2))
            feature[node - 1], cut[node - 1] = best[1], best[2] if np.isfinite(best[2]) else 1e300
            right = x[own, best[1]] > cut[node - 1]
            for child, sub in ((2 * node, own[~right]), (2 * node + 1, own[right])):
                parts[child] = sub
                if child >= 2**depth:
                    leaf[child - 2**depth] = float((y[sub].sum() + share) / (len(sub) + 1))
        out.append((feature, cut, leaf))
    return out


def vote(forest, depth: int = DEPTH) -> str:
    """SQL of the forest's mean vote over the features ``f``."""
    trees = ", ".join(
        f"named_struct('k', array({', '.join(map(str, k))}), 'c', array({', '.join(f'{c:.9E}D' for c in cut)}), 'leaf', array({', '.join(f'{v:.9E}D' for v in leaf)}))" for k, cut, leaf in forest
    )
    walk = f"aggregate(sequence(1, {depth}), 1, (n, d) -> 2 * n + if(f[t.k[n - 1]] > t.c[n - 1], 1, 0))"
    return f"aggregate(transform(array({trees}), t -> t.leaf[{walk} - {2**depth}]), 0D, (a, x) -> a + x) / {len(forest)}"


@lru_cache(1)
def _findings() -> list[tuple[str, int, str]]:
    return labelled_findings()


def train(spark: SparkSession, findings: list[tuple] | None = None):
    """The forest from labelled lines (line, label, path where known); their features come from the same expressions as those of documents."""
    findings = _findings() if findings is None else findings
    body = json.dumps([{"doc_id": i, "text": f[0], "path": f[2] if len(f) > 2 else ""} for i, f in enumerate(findings)])
    table = spark.range(1).select(F.inline(F.from_json(F.lit(body), "array<struct<doc_id:long,text:string,path:string>>")))
    rows = candidates(table, "path").select("doc_id", "word_no", "v", "f").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["word_no"], r["v"]))
    x = np.array([list(r["f"]) for r in rows])
    y = np.array([findings[r["doc_id"]][1] for r in rows], float)
    return grow(x, y)


_trained: dict[str, list] = {}


def default_forest(spark: SparkSession):
    """The forest of the default findings, trained once a driver process; it depends on nothing else."""
    if "forest" not in _trained:
        _trained["forest"] = train(spark)
    return _trained["forest"]


def scan(docs: DataFrame, forest=None, path: str | None = None, keep_from: float = 0.5) -> DataFrame:
    """doc_id, line_no, word_no (from 0 and from 1), kind, length, value_sha256, score, is_secret of each candidate.

    The value itself is not returned.
    """
    spark = docs.sparkSession
    forest = default_forest(spark) if forest is None else forest
    voted = candidates(docs, path).withColumn("score", F.expr(vote(forest)))
    found = voted.selectExpr("doc_id", "line_no", "word_no", "kind", "length(v) as length", "sha2(v, 256) as value_sha256", "score", f"score >= {keep_from} as is_secret")
    keys = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
        .where(F.col("line").contains("-----BEGIN ") & F.col("line").rlike(KEY_HEADER))
        .selectExpr("doc_id", "line_no", "0 as word_no", "'private_key' as kind", "length(line) as length", "sha2(line, 256) as value_sha256", "1D as score", "true as is_secret")
    )
    return found.unionByName(keys)


def report(docs: DataFrame) -> DataFrame:
    """The scan of a table that has no paths; a document's source stands for one."""
    return scan(docs, path="source")
