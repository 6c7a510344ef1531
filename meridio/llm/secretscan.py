"""Secret scan with corpus-wide ownership frequency.

Candidates are found by format rules, hashed, and counted over distinct repositories and distinct owners of the whole corpus: a
value that many owners or repositories carry is a copied example, one that stays with few is a credential of its owner if it
also looks like one (enough entropy, no placeholder). Everything runs on built-in expressions; only hashes, never the texts,
are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import written

#: (rule, pattern, whether the value is what stands in quotes). In the order of trial; the syntax is common to Java and RE2.
RULES = [
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False),
    ("aws_access_key", r"AKIA[0-9A-Z]{16}", False),
    ("github_token", r"gh[pousr]_[0-9A-Za-z]{36}", False),
    ("google_api_key", r"AIza[0-9A-Za-z_-]{35}", False),
    ("slack_token", r"xox[abprs]-[0-9A-Za-z-]{10,}", False),
    ("stripe_key", r"sk_live_[0-9a-zA-Z]{24}", False),
    ("api_key", r"sk-[0-9A-Za-z]{20,}", False),
    ("json_web_token", r"eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}", False),
    ("assigned_secret", r"""(?:[Pp]assword|PASSWORD|[Pp]asswd|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi_?[Kk]ey|API_?KEY|[Aa]ccess_?[Kk]ey)["']?[ \t]*[:=][ \t]*["'][^"' \t\r\n]{8,}["']""", True),
]
#: What follows a private key's header: all up to the END line, or the lines of a block that is cut off. Java's engine needs bounds
#: where DuckDB's has none; they differ for a block of over 200 lines that is cut off.
KEY_REST = r"(?:[^-]*+(?:-[^-]++){0,64}+-----END [A-Z ]*PRIVATE KEY-----|(?:(?:\\[rn]|\s){0,8}[0-9A-Za-z+/=]{40,}+){0,200}+)"
KEY_REST_RE2 = r"(?:[^-]*(?:-[^-]+){0,64}-----END [A-Z ]*PRIVATE KEY-----|(?:(?:\\[rn]|\s){0,8}[0-9A-Za-z+/=]{40,})*)"
SCANNED = [(n, p + KEY_REST if n == "private_key" else p, q) for n, p, q in RULES]
SCANNED_ALL = "|".join(f"(?:{p})" for _, p, _ in SCANNED)
#: A key's body shorter than this may hold a placeholder's words; a longer one holds some of them by chance.
SHORT_KEY = 100
PLACEHOLDER = r"(?i)example|placeholder|changeme|your[_-]|xxxx|dummy|sample|12345678|<[a-z_ ]+>|\$\{"


def _entropy(v: Column) -> Column:
    """Shannon entropy of a string's characters in bits."""
    chars = F.filter(F.split(v, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    share = F.transform(F.array_sort(F.array_distinct(chars)), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double") / n)
    return F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def scan_secrets(
    docs: DataFrame, *, owner_col: str = "source", repo_col: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    example_owners: int = 3, example_repos: int = 25, min_entropy: float = 2.5,
) -> DataFrame:
    """(doc_id, rule, secret_hash, n_in_doc, n_repos, n_owners, verdict): a row for each value in each document.

    The hash is SHA-256 of the value, which for a private key is its body without white space and escaped line ends (the header
    line if no body follows); values themselves aren't returned. The verdict is `shared_example` for a value of at
    least `example_owners` distinct owners or, where the table names them in `repo_col`, `example_repos` distinct repositories, else `placeholder` if it has the words of
    one or less than `min_entropy` bits a character (a private key's header line is exempt), else `owner_specific`.

    Without `repo_col` n_repos counts documents and has no say in the verdict: copies within one owner share nothing.

    Defined cases: null and empty texts have no findings; null owners and null repositories count as one owner and one
    repository each; a value found several times in a document gives one row with n_in_doc, and repeated rows of a document add
    to it; whole texts are scanned; extra columns are ignored; an empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("o"), F.col(repo_col or id_col).cast("string").alias("r"), F.explode(F.regexp_extract_all(text_col, F.lit(SCANNED_ALL), F.lit(0))).alias("hit"))
    rule = F.lit(None).cast("string")
    for name, pattern, _ in reversed(SCANNED):
        rule = F.when(F.col("hit").rlike(f"^(?:{pattern})$"), name).otherwise(rule)
    found = own.select("doc_id", "o", "r", rule.alias("rule"), "hit")
    quoted = [name for name, _, q in RULES if q]
    value = F.when(F.col("rule").isin(quoted), F.regexp_extract("hit", r"""["']([^"' \t\r\n]{8,})["']$""", 1)).otherwise(F.col("hit"))
    header = RULES[0][1]
    body = F.regexp_replace(F.regexp_replace("hit", rf"^{header}|-----END [A-Z ]*PRIVATE KEY-----$", ""), r"\\[rn]|\s+", "")
    value = F.when((F.col("rule") == "private_key") & (body != ""), body).otherwise(value)
    found = found.select("doc_id", "o", "r", "rule", value.alias("v"))
    key = F.col("rule") == "private_key"
    looks = (F.col("v").rlike(PLACEHOLDER) & (~key | (F.length("v") < SHORT_KEY))) | (~F.col("v").rlike(f"^{header}$") & (_entropy(F.col("v")) < min_entropy))
    # the texts are scanned once and the findings written; values are left behind before anything is shuffled
    found = found.select("doc_id", "o", "r", "rule", F.sha2("v", 256).alias("secret_hash"), looks.alias("looks"))
    found = written(found.groupBy("doc_id", "o", "r", "rule", "secret_hash", "looks").agg(F.count(F.lit(1)).alias("n")), "secrets")
    pairs = found.select("secret_hash", "o", "r").distinct()
    counts = pairs.groupBy("secret_hash").agg(
        F.count_distinct(F.coalesce(F.concat(F.lit("="), "r"), F.lit("-"))).alias("n_repos"), F.count_distinct(F.coalesce(F.concat(F.lit("="), "o"), F.lit("-"))).alias("n_owners")
    )
    shared = F.col("n_owners") >= example_owners
    if repo_col:
        shared = shared | (F.col("n_repos") >= example_repos)
    verdict = F.when(shared, "shared_example").when(F.col("looks"), "placeholder").otherwise("owner_specific")
    rows = found.join(counts, "secret_hash").withColumn("verdict", verdict)
    return rows.groupBy("doc_id", "rule", "secret_hash", "n_repos", "n_owners", "verdict").agg(F.sum("n").alias("n_in_doc"))


def _quote(s: str) -> str:
    return s.replace("'", "''")


_RE2 = [(n, p + KEY_REST_RE2 if n == "private_key" else p) for n, p, _ in RULES]
_ALL = "|".join(f"(?:{p})" for _, p in _RE2)
_WHEN = "\n".join(f"WHEN regexp_full_match(hit, '{_quote(p)}') THEN '{n}'" for n, p in _RE2)
_QUOTED = _quote(r"""["']([^"' \t\r\n]{8,})["']$""")
_HEADER = _quote(RULES[0][1])
ORACLE = rf"""
WITH own AS (SELECT doc_id, source AS o, CAST(doc_id AS VARCHAR) AS r, unnest(regexp_extract_all(text, '{_quote(_ALL)}')) AS hit FROM documents),
ruled AS (SELECT *, CASE {_WHEN} END AS rule FROM own),
bodies AS (SELECT *, regexp_replace(regexp_replace(hit, '^{_HEADER}|-----END [A-Z ]*PRIVATE KEY-----$', '', 'g'), '\\[rn]|\s+', '', 'g') AS body FROM ruled),
valued AS (SELECT doc_id, o, r, rule, CASE WHEN rule = 'assigned_secret' THEN regexp_extract(hit, '{_QUOTED}', 1) WHEN rule = 'private_key' AND body <> '' THEN body ELSE hit END AS v FROM bodies),
chars AS (SELECT v, unnest(string_split(v, '')) AS c FROM (SELECT DISTINCT v FROM valued)),
share AS (SELECT v, c, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY v) AS p FROM chars WHERE c <> '' GROUP BY v, c),
entropy AS (SELECT v, -sum(p * log2(p)) AS h FROM share GROUP BY v),
counts AS (SELECT v, count(DISTINCT r) AS n_repos, count(DISTINCT coalesce('=' || o, '-')) AS n_owners FROM valued GROUP BY v)
SELECT doc_id, rule, sha256(v) AS secret_hash, n_repos, n_owners,
  CASE WHEN n_owners >= 3 THEN 'shared_example'
       WHEN (regexp_matches(v, '{_quote(PLACEHOLDER)}') AND (rule <> 'private_key' OR length(v) < {SHORT_KEY})) OR (NOT regexp_full_match(v, '{_HEADER}') AND h < 2.5) THEN 'placeholder'
       ELSE 'owner_specific' END AS verdict, count(*) AS n_in_doc
FROM valued JOIN counts USING (v) JOIN entropy USING (v) GROUP BY ALL
"""
