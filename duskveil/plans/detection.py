"""Queries on scan, checks, redaction and decoding, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, text, validators
from ..operators import audit, decode, redact, structured
from ..operators.entropy import DEFAULT_THRESHOLD
from ..operators.rules import DEFAULT_RULES, Policy, Rule, rules_from_frame
from ..operators.scan import first_match, overall_action, scan, without_allowed
from ..session import read_table

KEY = b"example key for queries"
#: Default rules by a short name; these are plain patterns that SQL can hold against.
BY_NAME = {r.flag.split(".")[1]: r for r in DEFAULT_RULES}
TOKENS = [BY_NAME[n] for n in ("openai_api_key", "anthropic_api_key", "aws_access_key_id", "github_token", "stripe_key", "google_api_key", "slack_token")]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as they lie in the table. Findings of equal ids are one set, so copies of a row need not be taken out before a scan."""
    return read_table(spark, sf_dir, "messages").select("message_id", "content").where("content is not null")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, exact copies of a row once, for results with a row for each message."""
    return _texts(spark, sf_dir).distinct()


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


def _token_rows() -> str:
    parts = [
        f"select message_id, '{r.flag}' as flag, '{r.action}' as action, unnest(regexp_extract_all(content, '{_sql(r.patterns[0])}')) as value, {r.min_length} as lo, {r.max_length} as hi, {list(r.allowed_examples)}::varchar[] as ex from m"
        for r in TOKENS
    ]
    return (
        "with m as (select distinct message_id, content from messages where content is not null), raw as (" + " union all ".join(parts)
        + "), f as (select * from raw where strlen(value) between lo and hi and not list_contains(ex, value))"
    )


def scan_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all default rules over the messages, by flag."""
    found = scan(_texts(spark, sf_dir), ["message_id"], "content", DEFAULT_RULES, key=KEY)
    return found.groupBy("flag").agg(F.count(F.lit(1)).alias("n_findings"), F.countDistinct("message_id").alias("n_messages"))


def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of the default rules with its span and keyed hash."""
    return scan(_texts(spark, sf_dir), ["message_id"], "content", DEFAULT_RULES, key=KEY).withColumn("seq", F.to_json("seq"))


def scan_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_texts(spark, sf_dir), ["message_id"], "content", TOKENS, key=KEY, entropy_threshold=None, keep_value=True).select("message_id", "flag", "action", "hashed_value", "value")


def scan_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_texts(spark, sf_dir), ["message_id"], "content", [BY_NAME["email_address"]], entropy_threshold=None, keep_value=True).select("message_id", "value", "hashed_value")


def scan_env_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_texts(spark, sf_dir), ["message_id"], "content", [BY_NAME["env_block"]], entropy_threshold=None, keep_value=True).select("message_id", "value")


def scan_private_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [BY_NAME["pem_private_key"], BY_NAME["id_rsa_ssh_key"]]
    found = scan(_texts(spark, sf_dir), ["message_id"], "content", rules, entropy_threshold=None)
    return found.select("message_id", "flag", (F.col("end") - F.col("start")).alias("n_bytes"))


def context_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain numbers that count as phone numbers because a keyword stands on their line."""
    rule = DEFAULT_RULES[11]
    return scan(_texts(spark, sf_dir), ["message_id"], "content", [rule], entropy_threshold=None, keep_value=True).select("message_id", "value")


def entropy_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of high entropy near keywords."""
    found = scan(_texts(spark, sf_dir), ["message_id"], "content", [], entropy_threshold=DEFAULT_THRESHOLD, keep_value=True)
    return found.select("message_id", "start", "end", "value")


def rule_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the table's own rules over the messages, by flag."""
    rules = rules_from_frame(read_table(spark, sf_dir, "rules"))
    found = scan(_texts(spark, sf_dir), ["message_id"], "content", rules, entropy_threshold=None)
    return found.groupBy("flag").agg(F.count(F.lit(1)).alias("n_findings"))


def message_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongest action of each message under the token rules."""
    m = _texts(spark, sf_dir)
    return overall_action(m, scan(m, ["message_id"], "content", TOKENS, entropy_threshold=None), ["message_id"])


def allowlist_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token findings without those whose fingerprint is listed: here all that begin with AKIA are."""
    found = scan(_texts(spark, sf_dir), ["message_id"], "content", TOKENS, key=KEY, entropy_threshold=None, keep_value=True)
    listed = found.where("value like 'AKIA%'").select(hashing.allowlist_fingerprint(KEY, F.col("value")).alias("fingerprint"))
    return without_allowed(found, listed, KEY).select("message_id", "flag", "value")


def redact_google(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with one kind of token redacted."""
    m = _messages(spark, sf_dir)
    found = scan(m, ["message_id"], "content", [BY_NAME["google_api_key"]], entropy_threshold=None)
    return redact.redact(m, found, ["message_id"], "content").select("message_id", F.md5("redacted_text").alias("digest"), "blocked_by")


def redact_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages under a policy that redacts all secrets and personal data: no finding blocks."""
    m = _messages(spark, sf_dir)
    rules = Policy(categories={"secrets": "redact", "pii": "redact"}).effective(DEFAULT_RULES)
    found = scan(m, ["message_id"], "content", rules, key=KEY)
    return redact.redact(m, found, ["message_id"], "content").select("message_id", "redacted_text", "blocked_by")


def vault_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reversible redaction and back: every message comes out as it was."""
    m = _messages(spark, sf_dir)
    rules = [r for r in Policy(categories={"secrets": "redact"}).effective(TOKENS)]
    found = scan(m, ["message_id"], "content", rules, entropy_threshold=None)
    hidden = redact.redact_reversible(m, found, ["message_id"], "content", "salt")
    vault = redact.vault_table(hidden, F.lit(0))
    back = redact.unredact(hidden, ["message_id"], "redacted_text", vault)
    return back.select("message_id", F.col("restored_text").eqNullSafe(F.col("content")).alias("restored"), F.size("vault").alias("n_tokens"))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    return m.select("message_id", F.to_json(F.struct(F.lit("m").alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.col("content"))).alias("messages"), F.lit(0.5).alias("temperature"))).alias("body"))


def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String leaves of request bodies in walk order (keys sorted)."""
    return decode.leaves(_bodies(spark, sf_dir), ["message_id"], "body").select("message_id", "leaf_idx", F.md5("leaf").alias("digest"))


def json_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision findings of JSON bodies by flag: flat findings and uncovered leaf findings."""
    decision, _ = structured.scan_json(_bodies(spark, sf_dir), ["message_id"], "body", TOKENS, key=KEY, entropy_threshold=None)
    return decision.groupBy("flag").agg(F.count(F.lit(1)).alias("n_findings"), F.countDistinct("message_id").alias("n_messages"))


def redact_json_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON bodies with google tokens redacted in their leaves."""
    bodies = _bodies(spark, sf_dir)
    _, by_leaf = structured.scan_json(bodies, ["message_id"], "body", [BY_NAME["google_api_key"]], entropy_threshold=None)
    out = structured.redact_json(bodies, by_leaf, ["message_id"], "body")
    return out.select("message_id", F.md5(F.get_json_object("redacted_body", "$.messages[0].content")).alias("digest"))


def adapter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of request bodies: contents that are strings, whatever they look like, parts and numbers that are none, with and without a prompt."""
    kind, c = F.pmod("message_id", F.lit(5)), F.to_json(F.array(F.col("content")))
    quoted = F.substring(c, F.lit(2), F.length(c) - 2)
    body = (
        F.when(kind == 0, F.concat(F.lit('{"messages":[{"role":"user","content":'), quoted, F.lit("}]}")))
        .when(kind == 1, F.concat(F.lit('{"messages":[{"content":'), quoted, F.lit('},{"content":["part"]},{"content":7},{"role":"x"},{"content":"end"}],"prompt":"more"}')))
        .when(kind == 2, F.concat(F.lit('{"prompt":'), quoted, F.lit("}")))
        .when(kind == 3, F.concat(F.lit('{"messages":[{"content":[{"text":'), quoted, F.lit('}]}],"prompt":5}')))
        .otherwise(F.concat(F.lit('{"messages":'), quoted, F.lit("")))
    )
    return _messages(spark, sf_dir).select("message_id", F.md5(decode.adapted_text(body)).alias("digest"))


def multipart_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text regions of multipart bodies built from messages: preamble, headers, payloads; one binary part each is passed over."""
    m = _messages(spark, sf_dir)
    head = "before\r\n--cut\r\nContent-Type: text/plain\r\n\r\n"
    tail = "\r\n--cut\r\nContent-Type: image/png\r\n\r\nxyz\r\n--cut--\r\nafter"
    bodies = m.select("message_id", F.concat(F.lit(head), "content", F.lit(tail)).cast("binary").alias("body"), F.lit("multipart/form-data; boundary=cut").alias("content_type"))
    out = decode.decode(bodies, "body", "content_type")
    return out.select("message_id", "decoded.kind", F.size("decoded.regions").alias("n_regions"), "decoded.binary_parts")


def audit_from_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of messages with findings of the token rules."""
    found = scan(_texts(spark, sf_dir), ["message_id"], "content", TOKENS, key=KEY, entropy_threshold=None)
    events = audit.events_from_findings(found, ["message_id"])
    return events.select("message_id", F.array_join(F.array_sort("flags"), ",").alias("flags"), "severity", "total", F.size("hashed_values").alias("n_hashes"))


def feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_texts(spark, sf_dir), ["message_id"], "content", TOKENS, entropy_threshold=None)
    return audit.feedback(found, ["message_id"]).select("message_id", "total", "max_severity", "summary")


FX_VALUES = [
    "4111 1111 1111 1111", "4111111111111112", "0000000000000000", "+4111111111111111", "+9999999999999995", "5500-0000-0000-0004", "378282246310005", "18", "",
    "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "GB82WEST12345698765431", "de89370400440532013000", "aaaaaaaa", "abcdefgh", "3f9aZ!q8Lw",
]


def _values(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(FX_VALUES)], "id int, value string")


def validator_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return _values(spark).select(
        "id", validators.luhn(v).alias("luhn"), validators.payment_card(v).alias("payment_card"), validators.not_payment_card(v).alias("not_payment_card"),
        validators.iban(v).alias("iban"), F.round(validators.shannon_entropy(v), 9).alias("entropy"),
    )


def luhn_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luhn over numbers made of the events table."""
    e = read_table(spark, sf_dir, "events").select("event_id", (F.lit(4_000_000_000_000_000).cast("bigint") + F.col("event_id") * 7919).cast("string").alias("number"))
    return e.select("event_id", validators.luhn(F.col("number")).alias("valid"))


def entropy_of_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of each distinct hash in the audit events."""
    h = read_table(spark, sf_dir, "audit_events").select(F.explode("hashed_values").alias("h")).where("h is not null").distinct()
    return h.select("h", F.round(validators.shannon_entropy(F.col("h")), 6).alias("bits"))


def hash_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "audit_events").select("tool").where("tool is not null").distinct()
    return t.select("tool", hashing.sha256_value(F.col("tool")).alias("plain"), hashing.domain_hash(KEY, hashing.DOMAIN_FINDING, F.col("tool")).alias("keyed"))


def effective_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's rules under a policy: one category blocked, one flag allowed, one rule replaced, one added."""
    base = rules_from_frame(read_table(spark, sf_dir, "rules"))
    policy = Policy(
        categories={"internal_code": "block"}, rules={"pii.email_address": "allow"},
        custom_rules=[Rule("pii.phone_number", "pii", "high", (r"\d{9}",), "redact"), Rule("custom.digits", "internal_code", "low", (r"\d+",), "warn")],
    )
    policy.check()
    return spark.createDataFrame([(r.flag, r.category, r.severity, r.action, " | ".join(r.patterns)) for r in policy.effective(base)], "flag string, category string, severity string, action string, patterns string")


def text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of text sizes by source; texts are cut to 200 bytes at a character boundary."""
    d = read_table(spark, sf_dir, "documents").where("text is not null").select(F.octet_length("text").alias("n"), F.octet_length(text.truncate_bytes(F.col("text"))).alias("cut"))
    return d.agg(*(text.percentile_nearest_rank(F.col("n"), p).alias(f"p{round(100 * p)}") for p in (0.5, 0.95, 0.99)), F.max("cut").alias("longest_cut"))


FX_TEXTS = ["v1.20.3-rc", "2.0", "https://Api.Example:8443/v1", "a\nb\nc\n", "[VAULT:" + "0" * 32 + "] and [VAULT:" + "1" * 32 + "]", "hmac:" + "ab" * 32, "sha256:xyz", "  padded\u00a0", ""]


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions over a few texts."""
    v = F.col("value")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(FX_TEXTS)], "id int, value string")
    return rows.select(
        "id", text.semver(v)["minor"].cast("string").alias("minor"), text.url_host(v).alias("host"), text.last_lines(v, 2).alias("tail"), F.size(text.token_ids(v)).alias("n_tokens"),
        hashing.display_fingerprint(v).alias("shown"), hashing.strip_hash_prefix(v).alias("bare"), hashing.unicode_trim(v).alias("trimmed"), hashing.is_fingerprint(v).alias("fingerprint"),
    )


def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of a scan for each message: findings by flag as text, number of hashes, strongest action."""
    found = scan(_texts(spark, sf_dir), ["message_id"], "content", TOKENS, key=KEY, entropy_threshold=None)
    r = audit.scan_report(found, ["message_id"])
    counts = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return r.select("message_id", counts.alias("counts"), F.size("hashed_values").alias("n_hashes"), "action")


def first_private_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First private key block of each message that has one."""
    m = _messages(spark, sf_dir).select("message_id", first_match(F.col("content"), BY_NAME["pem_private_key"]).alias("block"))
    return m.where("block is not null").select("message_id", F.md5("block").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_flags, scan_findings, scan_tokens, scan_email, scan_env_block, scan_private_keys, context_phone, entropy_values, rule_table_scan, message_actions,
        allowlist_antijoin, redact_google, redact_policy, vault_round_trip, json_leaves, json_decision, redact_json_bodies, adapter_text, multipart_regions,
        audit_from_findings, feedback_summary, validator_table, luhn_of_events, entropy_of_hashes, hash_tools, effective_rules, text_lengths,
        text_functions, scan_report, first_private_key,
    )
}

_LUHN = """(length({d}) between 13 and 19 and {d} <> repeat(left({d}, 1), length({d})) and
  list_sum(list_transform(range(length({d})), lambda i: case when i % 2 = 0 then cast(substr(reverse({d}), i + 1, 1) as int)
    else case when cast(substr(reverse({d}), i + 1, 1) as int) > 4 then 2 * cast(substr(reverse({d}), i + 1, 1) as int) - 9 else 2 * cast(substr(reverse({d}), i + 1, 1) as int) end end)) % 10 = 0)"""


def _hmac_sql(key: bytes, domain: str, column: str) -> str:
    padded = key.ljust(64, b"\0")
    blob = lambda raw: "'" + "".join(f"\\x{b:02X}" for b in raw) + "'::blob"
    inner, outer = bytes(b ^ 0x36 for b in padded), bytes(b ^ 0x5C for b in padded)
    return f"'hmac:' || sha256({blob(outer)} || unhex(sha256({blob(inner)} || {blob(domain.encode() + bytes(1))} || encode({column}))))"


_MSG = "with m as (select distinct message_id, content from messages where content is not null) "
_GOOGLE = _sql(BY_NAME["google_api_key"].patterns[0])
_ISSUER_CARD = "(not starts_with(value, '+') or (substr(d, 1, 1) = '4' and length(d) in (13, 16, 19)))"
ORACLES = {
    "scan_tokens": _token_rows() + f" select message_id, flag, action, {_hmac_sql(KEY, hashing.DOMAIN_FINDING, 'value')} as hashed_value, value from f",
    "scan_email": _MSG
    + """, f as (select message_id, unnest(regexp_extract_all(content, '(?:^|[^\\pL\\pN_])([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,})\\b', 1)) as value from m)
    select message_id, value, 'sha256:' || sha256(value) as hashed_value from f where strlen(value) between 5 and 254 and value <> 'user@example.com'""",
    "scan_env_block": _MSG + f"select message_id, unnest(regexp_extract_all(content, '{_sql(BY_NAME['env_block'].patterns[0])}')) as value from m",
    "scan_private_keys": _MSG
    + ", f as ("
    + " union all ".join(
        f"select message_id, '{BY_NAME[n].flag}' as flag, unnest(regexp_extract_all(content, '{_sql(BY_NAME[n].patterns[0]).replace('(RSA', '(?:RSA')}')) as v from m" for n in ("pem_private_key", "id_rsa_ssh_key")
    )
    + ") select message_id, flag, strlen(v) as n_bytes from f",
    "context_phone": _MSG
    + f""", l as (select message_id, unnest(string_split(content, chr(10))) as line from m),
    f as (select message_id, unnest(regexp_extract_all(line, '\\b[1-9][0-9]{{6,14}}\\b')) as value from l
      where regexp_matches(line, '(?i)(?:^|[^\\pL\\pN\\pM])(?:{"|".join(k.replace(".", chr(92) + ".") for k in DEFAULT_RULES[11].context_keywords)})(?:$|[^\\pL\\pN\\pM])'))
    select message_id, value from f where not coalesce({_LUHN.format(d='value')}, false)""",
    "message_actions": _token_rows()
    + """ select m.message_id, case max(case action when 'block' then 3 when 'redact' then 2 when 'warn' then 1 else 0 end) when 3 then 'block' when 2 then 'redact' when 1 then 'warn' else 'allow' end as action_overall,
    count(flag) as n_findings from m left join f using (message_id) group by m.message_id""",
    "allowlist_antijoin": _token_rows() + " select message_id, flag, value from f where not starts_with(value, 'AKIA')",
    "redact_google": _MSG + f"select message_id, md5(regexp_replace(content, '{_GOOGLE}', '[REDACTED:secret.google_api_key]', 'g')) as digest, null::varchar as blocked_by from m",
    "redact_json_bodies": _MSG + f"select message_id, md5(regexp_replace(content, '{_GOOGLE}', '[REDACTED:secret.google_api_key]', 'g')) as digest from m",
    "vault_round_trip": _token_rows() + " select m.message_id, true as restored, count(flag) as n_tokens from m left join f using (message_id) group by m.message_id",
    "json_leaves": _MSG + "select message_id, 0 as leaf_idx, md5(content) as digest from m union all select message_id, 1, md5('user') from m union all select message_id, 2, md5('m') from m",
    "json_decision": _token_rows() + " select flag, count(*) as n_findings, count(distinct message_id) as n_messages from f group by flag",
    "adapter_text": _MSG + "select message_id, md5(case message_id % 5 when 0 then content when 1 then content || ' end more' when 2 then content end) as digest from m",
    "multipart_regions": _MSG + "select message_id, 'multipart' as kind, case when content = '' then 4 else 5 end as n_regions, 1 as binary_parts from m",
    "audit_from_findings": _token_rows()
    + f""" select message_id, string_agg(distinct flag, ',' order by flag) as flags,
    case when bool_or(flag not in ('secret.google_api_key', 'secret.slack_token')) then 'critical' else 'high' end as severity, count(*) as total, count(distinct value) as n_hashes from f group by message_id""",
    "feedback_summary": _token_rows()
    + """, a as (select message_id, action, count(*) as n from f group by all)
    select message_id, cast(sum(n) as bigint) as total, (select case when bool_or(flag not in ('secret.google_api_key', 'secret.slack_token')) then 'critical' else 'high' end from f where f.message_id = a.message_id) as max_severity,
    sum(n)::bigint || ' finding(s) [' || string_agg(action || ': ' || n, ', ' order by action) || ']' as summary from a group by message_id""",
    "validator_table": "with t(id, value) as (values " + ", ".join(f"({i}, '{_sql(v)}')" for i, v in enumerate(FX_VALUES)) + "), "
    + f"""x as (select id, value, regexp_replace(value, '[^0-9]', '', 'g') as d, regexp_replace(value, '\\s', '', 'g') as i from t),
    y as (select *, coalesce({_LUHN.format(d='d')}, false) as luhn,
      regexp_full_match(i, '[A-Z0-9]{{15,34}}') and list_reduce(list_prepend(0, list_transform(string_split(substr(i, 5) || substr(i, 1, 4), ''), lambda c: case when c between '0' and '9' then cast(c as int) else coalesce(ascii(c) - 55, 0) end)),
        lambda a, b: (a * (case when b > 9 then 100 else 10 end) + b) % 97) = 1 as iban from x),
    bits as (select id, -sum(n * 1.0 / t * log2(n * 1.0 / t)) as bits from (select id, c, count(*) as n, any_value(length(value)) as t from (select id, value, unnest(string_split(value, '')) as c from t where value <> '') group by id, c) group by id)
    select y.id, luhn, luhn and {_ISSUER_CARD} as payment_card, not (luhn and {_ISSUER_CARD}) as not_payment_card, coalesce(iban, false) as iban,
      coalesce(round(bits, 9), 0.0) + 0.0 as entropy from y left join bits using (id)""",
    "luhn_of_events": f"with e as (select event_id, cast(4000000000000000 + event_id * 7919 as varchar) as d from events) select event_id, {_LUHN.format(d='d')} as valid from e",
    "entropy_of_hashes": f"""with h as (select distinct h from (select unnest(hashed_values) as h from audit_events) where h is not null),
    c as (select h, unnest(string_split(h, '')) as c from h), n as (select h, c, count(*) as n from c group by all)
    select h, round(-sum(n * 1.0 / length(h) * log2(n * 1.0 / length(h))), 6) as bits from n group by h""",
    "hash_tools": f"select tool, 'sha256:' || sha256(tool) as plain, {_hmac_sql(KEY, hashing.DOMAIN_FINDING, 'tool')} as keyed from (select distinct tool from audit_events where tool is not null)",
    "effective_rules": """with b as (select flag, category, severity, action, array_to_string(patterns, ' | ') as patterns from rules where flag not in ('pii.phone_number', 'custom.digits')
      union all values ('pii.phone_number', 'pii', 'high', 'redact', '\\d{9}'), ('custom.digits', 'internal_code', 'low', 'warn', '\\d+'))
    select flag, category, severity, case when flag = 'pii.email_address' then 'allow' when category = 'internal_code' then 'block' else action end as action, patterns from b""",
    "text_lengths": """with n as (select strlen(text) as n, text from documents where text is not null),
    c as (select n, text, case when strlen(text) <= 200 then strlen(text) else (select max(strlen(left(text, k))) from (select unnest(range(0, 201)) as k) where strlen(left(text, k)) <= 200) end as cut from n)
    select quantile_disc(n, 0.5) as p50, quantile_disc(n, 0.95) as p95, quantile_disc(n, 0.99) as p99, max(cut) as longest_cut from c""",
    "text_functions": "with t(id, v) as (values " + ", ".join("(%d, '%s')" % (i, _sql(t)) for i, t in enumerate(FX_TEXTS)) + """)
    select id, nullif(regexp_extract(v, '^v?(\\d+)\\.(\\d+)\\.(\\d+)(?:[-+].*)?$', 2), '') as minor, lower(nullif(regexp_extract(v, '^[a-z]+://([^/:]+)', 1), '')) as host,
      array_to_string(string_split(rtrim(v, chr(10)), chr(10))[-2:], chr(10)) as tail, len(list_distinct(regexp_extract_all(v, '\\[VAULT:([0-9a-f]{32})\\]', 1))) as n_tokens,
      case when regexp_full_match(v, 'hmac:[0-9a-fA-F]{64}') then substr(v, 1, 17) || '…' else v end as shown, regexp_replace(v, '^(hmac|sha256):', '') as bare,
      regexp_replace(v, '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g') as trimmed, regexp_full_match(v, 'hmac:[0-9a-fA-F]{64}') as fingerprint from t""",
    "scan_report": _token_rows()
    + """, c as (select message_id, flag, any_value(action) as action, count(*) as n from f group by message_id, flag)
    select message_id, string_agg(flag || '=' || n, ',' order by flag) as counts, sum(n)::int as n_hashes, case when bool_or(action = 'block') then 'block' else 'redact' end as action from c group by message_id""",
    "first_private_key": _MSG
    + f"select message_id, md5(regexp_extract(content, '{_sql(BY_NAME['pem_private_key'].patterns[0])}')) as digest from m where regexp_matches(content, '{_sql(BY_NAME['pem_private_key'].patterns[0])}')",
}
