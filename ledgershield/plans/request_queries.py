"""Request shaping, policy loading and token joins over the request tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import timing as TM
from ..functions.patterns import DEFAULT_MODEL, DETECTORS, Detector
from ..operators import envelope as EN
from ..operators import redaction as RD
from ..operators import routing as RT
from ..session import scratch_path, written
from ..sources import domain as D
from ..sources import files
from .gateway import KEY, ROUTE_CTES, _policies, _redacted_requests, corpus
from .oracle_common import CORPUS_CTE, PROMPTS_CTE, q, redaction_ctes, total_expr
from .registry import register

MSG_CTE = """msg AS (
  SELECT 'req_' || substr(sha256('conv:' || conv_id::VARCHAR), 1, 16) AS request_id, conv_id, turn, role, text,
         't' || (conv_id % 4)::VARCHAR AS tenant,
         CASE WHEN (conv_id + turn) % 7 = 6 THEN 'image' ELSE 'text' END AS block_type
  FROM conversations)"""


def _msgs(spark, sf_dir):
    return D.chat_messages(spark, sf_dir)


@register("request_source", "2.1", f"""WITH {MSG_CTE}
SELECT request_id, tenant, coalesce(arg_min(text, turn) FILTER (WHERE role = 'system'), '') AS system_text,
       count(*) FILTER (WHERE role <> 'system') AS n_messages, count(*) FILTER (WHERE role = 'user') AS n_user
FROM msg GROUP BY request_id, tenant""")
def request_source(spark, sf_dir):
    """Conversations grouped to requests: system prompt and message counts."""
    m = _msgs(spark, sf_dir)
    sys_turn = F.when(F.col("role") == "system", F.col("turn"))
    return m.groupBy("request_id", "tenant").agg(
        F.coalesce(F.min_by(F.when(F.col("role") == "system", F.col("text")), sys_turn), F.lit("")).alias("system_text"),
        F.count(F.when(F.col("role") != "system", 1)).alias("n_messages"),
        F.count(F.when(F.col("role") == "user", 1)).alias("n_user"))


@register("text_only_content", "2.2", f"""WITH {MSG_CTE}
SELECT request_id, turn, block_type, CASE WHEN block_type = 'text' THEN text ELSE '' END AS classified_text FROM msg""")
def text_only_content(spark, sf_dir):
    m = _msgs(spark, sf_dir)
    return m.select("request_id", "turn", "block_type",
                    F.when(F.col("block_type") == "text", F.col("text")).otherwise(F.lit("")).alias("classified_text"))


@register("reject_empty_messages", "2.2", f"""WITH cnt AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT 'req_' || substr(sha256('order:' || o.o_orderkey::VARCHAR), 1, 16) AS request_id,
       coalesce(c.n, 0) AS n_messages, c.n IS NOT NULL AS accepted,
       CASE WHEN c.n IS NULL THEN 'messages required' END AS reason
FROM orders o LEFT JOIN cnt c ON c.conv_id = o.o_orderkey""")
def reject_empty_messages(spark, sf_dir):
    """A request per order carries the conversation with its key; none -> 400.
    Messages are counted per conversation before the join (pre-aggregation)."""
    o = D.table(spark, sf_dir, "orders").select("o_orderkey")
    cnt = D.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("o_orderkey")) \
        .agg(F.count(F.lit(1)).alias("n"))
    j = o.join(cnt, "o_orderkey", "left")
    return j.select(D.request_id_of(F.col("o_orderkey"), "order").alias("request_id"),
                    F.coalesce("n", F.lit(0).cast("bigint")).alias("n_messages"),
                    F.col("n").isNotNull().alias("accepted"),
                    F.when(F.col("n").isNull(), F.lit("messages required")).alias("reason"))


def _ordered(m, *fields):
    """Messages of a request as an array sorted by turn (a conversation is a
    handful of turns: bounded per group)."""
    return F.array_sort(F.collect_list(F.struct("turn", *fields)))


@register("text_block_concat", "2.2", f"""WITH {MSG_CTE}
SELECT request_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant' AND block_type = 'text'), '')
         AS response_text,
       count(*) FILTER (WHERE role = 'assistant') AS n_blocks
FROM msg GROUP BY request_id""")
def text_block_concat(spark, sf_dir):
    m = _msgs(spark, sf_dir)
    g = m.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant",
                                           F.struct("turn", "block_type", "text")))).alias("blocks"))
    txt = F.array_join(F.transform(F.filter("blocks", lambda b: b["block_type"] == "text"), lambda b: b["text"]), "")
    return g.select("request_id", txt.alias("response_text"), F.size("blocks").cast("bigint").alias("n_blocks"))


@register("prepend_system", "2.2", f"""WITH {MSG_CTE},
s AS (SELECT request_id, arg_min(text, turn) FILTER (WHERE role = 'system') AS sys,
             string_agg(role, ',' ORDER BY turn) FILTER (WHERE role <> 'system') AS roles,
             count(*) FILTER (WHERE role <> 'system') AS n FROM msg GROUP BY request_id)
SELECT request_id, CASE WHEN sys IS NOT NULL THEN 'system' || CASE WHEN n > 0 THEN ',' ELSE '' END ELSE '' END
         || coalesce(roles, '') AS payload_roles,
       n + CASE WHEN sys IS NOT NULL THEN 1 ELSE 0 END AS n_payload FROM s""")
def prepend_system(spark, sf_dir):
    """Payload = system message first (if set), then the other messages in order."""
    m = _msgs(spark, sf_dir)
    g = m.groupBy("request_id").agg(
        F.min_by(F.when(F.col("role") == "system", F.col("text")), F.when(F.col("role") == "system", F.col("turn")))
         .alias("sys"),
        F.array_sort(F.collect_list(F.when(F.col("role") != "system", F.struct("turn", "role", "text"))))
         .alias("msgs"))
    payload = F.concat(F.when(F.col("sys").isNotNull(), F.array(F.struct(F.lit("system").alias("role"),
                                                                         F.col("sys").alias("content"))))
                       .otherwise(F.array().cast("array<struct<role:string,content:string>>")),
                       F.transform("msgs", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))))
    return g.select("request_id", payload.alias("p")).select(
        "request_id", F.array_join(F.transform("p", lambda x: x["role"]), ",").alias("payload_roles"),
        F.size("p").cast("bigint").alias("n_payload"))


# start and end of a call as the gateway would store them, and the elapsed whole milliseconds
TIMES_CTE = """times AS (
  SELECT o_orderkey, o_orderdate::TIMESTAMP + to_microseconds((o_orderkey % 86400) * 1000000 + o_orderkey % 1000003) AS started_at,
         o_orderdate::TIMESTAMP + to_microseconds((o_orderkey % 86400) * 1000000 + o_orderkey % 1000003
                                                  + (o_orderkey * 7919) % 4000000) AS finished_at
  FROM orders)"""
_ELAPSED = "((epoch_us(finished_at) - epoch_us(started_at)) // 1000)::INTEGER"


@register("elapsed_ms", "2.10", f"""WITH {TIMES_CTE}
SELECT o_orderkey, {_ELAPSED} AS duration_ms FROM times""")
def elapsed_ms(spark, sf_dir):
    """Duration of a call from its stored start and end."""
    t = D.call_times(spark, sf_dir)
    return t.select("o_orderkey", TM.elapsed_ms(F.col("started_at"), F.col("finished_at")).alias("duration_ms"))


_RED_E, _RED_E_LAST = redaction_ctes("prompts", "text", "re")
_SORTED = sorted(d.entity.lower() for d in DETECTORS)


def _stats_json(rel: str) -> str:
    return "'{{' || concat_ws(',', " + ", ".join(f"CASE WHEN {rel}.n_{e} > 0 THEN '\"{e}\":' || {rel}.n_{e}::VARCHAR END" for e in _SORTED) + ") || '}}'"


def _j(x: str) -> str:
    return f"""CASE WHEN {x} IS NULL THEN 'null' ELSE '"' || {x} || '"' END"""


# (every text here is ASCII without quotes, so a quoted string is its JSON form)
RECORD_CTES = f"""{ROUTE_CTES}, {TIMES_CTE},
{_RED_E},
calls AS (
  SELECT p.o_orderkey, p.request_id, p.tenant, p.user_name, p.text, r.t AS redacted, {total_expr('r')} AS total,
         {_stats_json('r').replace('{{', '{').replace('}}', '}')} AS stats,
         d.tier, d.reason, coalesce(nullif(p.model, ''), {q(DEFAULT_MODEL)}) AS model,
         strftime(started_at, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS timestamp, {_ELAPSED} AS duration_ms,
         'Noted: ' || CASE WHEN d.tier = 'private' THEN r.t ELSE p.text END AS answer
  FROM prompts p JOIN decision d USING (request_id) JOIN times USING (o_orderkey) JOIN {_RED_E_LAST} r USING (o_orderkey)),
hashed AS (
  SELECT *, sha256('{{"duration_ms":' || duration_ms::VARCHAR || ',"error":null,"host":"gw-host-1","model":"' || model
         || '","prompt_hash":"' || sha256(text) || '","redacted_prompt_hash":' || {_j("CASE WHEN tier = 'private' THEN sha256(redacted) END")}
         || ',"redaction_stats":' || stats || ',"request_id":"' || request_id || '","response_hash":"' || sha256(answer)
         || '","status":"ok","tenant":"' || tenant || '","tier":"' || tier || '","timestamp":"' || timestamp || '","user":"' || user_name || '"}}') AS hash
  FROM calls)"""


@register("response_envelope", "2.2", f"""WITH {RECORD_CTES}
SELECT o_orderkey, '{{"id":"' || request_id || '","type":"message","role":"assistant","model":"' || model
       || '","content":[{{"type":"text","text":"' || answer || '"}}],"stop_reason":"end_turn","usage":{{"input_chars":' || length(text)::VARCHAR
       || ',"output_chars":' || length(answer)::VARCHAR || ',"entities_redacted":' || total::VARCHAR
       || '}},"gateway":{{"tier":"' || tier || '","tier_reason":"' || reason || '","backend":"regex","tenant":"' || tenant
       || '","redaction":' || stats || ',"duration_ms":' || duration_ms::VARCHAR || ',"audit_hash":"' || hash || '"}}}}' AS envelope FROM hashed""")
def response_envelope(spark, sf_dir):
    """The whole record of a call as it goes back to the caller: model, content, usage, and the gateway's tier, reason,
    backend, tenant, counts, duration and audit hash, as one nested column."""
    requests = D.prompt_requests(spark, sf_dir)
    model = F.coalesce(F.nullif(F.col("model"), F.lit("")), F.lit(DEFAULT_MODEL))
    red = RD.redact_text(requests.withColumn("model", model), "text")
    routed = RT.route(red.drop("tokens", *[c for c in red.columns if c.startswith("n_") and c != "n_entities"]), _policies(spark))
    times = D.call_times(spark, sf_dir).select("o_orderkey", F.col("started_at"), TM.elapsed_ms(F.col("started_at"), F.col("finished_at")).alias("duration_ms"))
    answer = F.concat(F.lit("Noted: "), F.when(F.col("tier") == "private", F.col("redacted_text")).otherwise(F.col("text")))
    return EN.envelopes(routed.withColumn("response_text", answer).join(times, "o_orderkey"), "o_orderkey") \
        .select("o_orderkey", F.to_json("envelope", {"ignoreNullFields": "false"}).alias("envelope"))


@register("redactor_backend", "2.3", f"""WITH {CORPUS_CTE}
SELECT CASE WHEN kind = 'doc' THEN 'spans' ELSE 'regex' END AS backend, count(*) AS n_texts FROM corpus GROUP BY 1""")
def redactor_backend(spark, sf_dir):
    """Documents have detector spans and take the span path, the other texts the patterns; the backend column says which."""
    texts = corpus(spark, sf_dir).select("kind", F.col("id").alias("doc_id"), "text")
    by_spans = RD.redact_documents(texts.where("kind = 'doc'"), D.ner_spans(spark, sf_dir))
    by_regex = RD.redact_documents(texts.where("kind != 'doc'"))
    return by_spans.unionByName(by_regex).groupBy("backend").agg(F.count(F.lit(1)).alias("n_texts"))


@register("force_backend", "2.12", f"""WITH {redaction_ctes("documents", "text", "fb")[0]}
SELECT doc_id, 'regex' AS backend, t AS redacted_text FROM {redaction_ctes("documents", "text", "fb")[1]}""")
def force_backend(spark, sf_dir):
    """Documents with spans, but the patterns are asked for."""
    docs = D.table(spark, sf_dir, "documents").select("doc_id", "text")
    return RD.redact_documents(docs, D.ner_spans(spark, sf_dir), prefer=RD.REGEX).select("doc_id", "backend", "redacted_text")


LINK = Detector("LINK", r"https?://[A-Za-z0-9./_-]+", needles=("://",))
_RED_L, _RED_L_LAST = redaction_ctes("pages", "html", "rl", DETECTORS + (LINK,))


@register("add_detector", "2.12", f"""WITH {_RED_L}
SELECT page_id, t AS redacted_text, n_link, n_email FROM {_RED_L_LAST}""")
def add_detector(spark, sf_dir):
    """Pages redacted with one more detector, after the built-in ones."""
    pages = D.table(spark, sf_dir, "pages").select("page_id", "html")
    return RD.redact_text(pages, "html", DETECTORS + (LINK,)).select("page_id", "redacted_text", "n_link", "n_email")


@register("add_rule_type", "2.12", f"""WITH {PROMPTS_CTE}, {_RED_E}
SELECT request_id, CASE WHEN length(text) > 90 THEN 'sealed' WHEN {total_expr()} > 1 THEN 'private' ELSE 'public' END AS tier,
       CASE WHEN length(text) > 90 THEN 1 WHEN {total_expr()} > 1 THEN 2 END::INTEGER AS rule_no FROM {_RED_E_LAST}""")
def add_rule_type(spark, sf_dir):
    """A rule on the prompt's length, of a type that is not built in, before a built-in one."""
    types = RT.with_rule_type("if_prompt_longer_than", lambda rule, request: F.length(request["text"]) > RT.param(rule, "if_prompt_longer_than", "int"))
    doc = {"rules": [{"if_prompt_longer_than": 90, "then_tier": "sealed"}, {"if_max_entities_gt": 1, "then_tier": "private"}]}
    red = RD.redact_text(D.prompt_requests(spark, sf_dir), "text").withColumn("explicit_tier", F.lit(None).cast("string"))
    return RT.route(red, RT.policies_from_docs(spark, {t: doc for t in D.policy_catalog()}), rule_types=types).select("request_id", "tier", "rule_no")


def _rule_rows_sql() -> str:
    rows = []
    for tenant, doc in sorted(D.policy_catalog().items()):
        t, _name, _dt, _allow, rules, found = RT._policy_row(tenant, doc)
        for n, ents, thr, tier, _ in rules:
            rows.append(f"({q(t)}, {n}, {q(','.join(ents)) if ents else 'NULL'}, "
                        f"{thr if thr is not None else 'NULL::INTEGER'}, {q(tier) if tier else 'NULL'}, "
                        f"{str(found).upper()})")
    return ("eff(tenant, rule_no, entity_in, max_entities_gt, then_tier, policy_found) AS (VALUES "
            + ", ".join(rows) + ")")


@register("policy_defaults", "2.4", f"""WITH {PROMPTS_CTE}, {_rule_rows_sql()}
SELECT e.tenant, e.rule_no::INTEGER AS rule_no, e.entity_in, e.max_entities_gt::INTEGER AS max_entities_gt,
       e.then_tier, e.policy_found
FROM (SELECT DISTINCT tenant FROM prompts) t JOIN eff e ON e.tenant = t.tenant""")
def policy_defaults(spark, sf_dir):
    """Effective rules of every tenant seen in the requests: its own rules, or
    the default rules when it has no policy file."""
    tenants = D.prompt_requests(spark, sf_dir).select("tenant").distinct()
    pol = RT.with_policy(tenants, _policies(spark))
    return pol.select("tenant", "policy_found", F.explode("rules").alias("r")).select(
        "tenant", F.col("r.rule_no").alias("rule_no"),
        F.when(F.size("r.entity_in") > 0, F.array_join("r.entity_in", ",")).alias("entity_in"),
        F.col("r.max_entities_gt").alias("max_entities_gt"), F.col("r.then_tier").alias("then_tier"),
        "policy_found")


def _write_policy_files(spark) -> str:
    import yaml
    d = scratch_path(spark, f"tenants-{uuid.uuid4().hex}")
    for t, doc in D.policy_catalog().items():
        if doc is not None:
            files.put_once(spark, f"{d}/{t}.yaml", yaml.safe_dump(doc))
    return d


def _policy_load_sql() -> str:
    rows = []
    for tenant, doc in sorted(D.policy_catalog().items()):
        if doc is None:
            continue
        t, name, dt, allow, rules, _ = RT._policy_row(tenant, doc)
        rows.append(f"({q(t)}, {q(name)}, {q(dt)}, {str(allow).upper()}, {len(rules)})")
    return "files(tenant, name, default_tier, allow_override, n_rules) AS (VALUES " + ", ".join(rows) + ")"


@register("policy_load", "2.1", f"""WITH {PROMPTS_CTE}, {_policy_load_sql()}
SELECT t.tenant, coalesce(f.name, t.tenant) AS name, coalesce(f.default_tier, 'public') AS default_tier,
       coalesce(f.allow_override, FALSE) AS allow_override, coalesce(f.n_rules, 2) AS n_rules,
       f.tenant IS NOT NULL AS policy_found
FROM (SELECT DISTINCT tenant FROM prompts) t LEFT JOIN files f ON f.tenant = t.tenant""")
def policy_load(spark, sf_dir):
    """Tenant YAML files -> policies, joined to the tenants of the requests.  No file -> all
    defaults with the tenant id as name; an explicit empty rule list -> no rules."""
    pol = RT.load_policies(spark, _write_policy_files(spark))
    tenants = D.prompt_requests(spark, sf_dir).select("tenant").distinct()
    j = RT.with_policy(tenants, pol)
    return j.select("tenant", F.col("policy_name").alias("name"), "default_tier", "allow_override",
                    F.size("rules").cast("int").alias("n_rules"), "policy_found")


@register("join_rules", "2.5", f"""WITH {ROUTE_CTES}
SELECT r.request_id, count(f.rule_no) AS n_fired, min(f.rule_no)::INTEGER AS first_rule
FROM req r LEFT JOIN fired f ON f.request_id = r.request_id GROUP BY r.request_id""")
def join_rules(spark, sf_dir):
    """requests x rules: equi on tenant, rule condition as the residual;
    per request the number of firing rules and the first one."""
    reqs = written(_redacted_requests(spark, sf_dir), "redacted-requests")      # read twice, redacted once
    fired = RT.fired_rules(reqs, _policies(spark), which="any")
    g = fired.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_fired"), F.min("rule_no").alias("first_rule"))
    return reqs.select(*KEY).join(g, KEY, "left").select(
        "request_id", F.coalesce("n_fired", F.lit(0).cast("bigint")).alias("n_fired"), "first_rule")


@register("entity_tag_intersection", "2.9", f"""WITH {ROUTE_CTES}
SELECT r.request_id, u.rule_no::INTEGER AS rule_no,
       array_to_string(list_sort(list_distinct(list_filter(list_transform(u.entity_in, lambda x: lower(x)),
                                                           lambda x: list_contains(r.present, x)))), ',') AS matched
FROM req r JOIN rules u ON u.tenant = r.tenant
WHERE u.entity_in IS NOT NULL
  AND len(list_filter(list_transform(u.entity_in, lambda x: lower(x)), lambda x: list_contains(r.present, x))) > 0""")
def entity_tag_intersection(spark, sf_dir):
    """wanted (rule's entity list, case-insensitive) ∩ present (types with a hit)."""
    reqs = _redacted_requests(spark, sf_dir)
    pol = RT.with_policy(reqs, _policies(spark))
    ex = pol.select("request_id", "stats", F.explode("rules").alias("r"))
    present = F.map_keys(F.map_filter("stats", lambda k, v: v > 0))
    inter = F.array_sort(F.array_intersect(F.transform("r.entity_in", lambda x: F.lower(x)), present))
    return ex.where(F.col("r.entity_in").isNotNull() & (F.size(inter) > 0)).select(
        "request_id", F.col("r.rule_no").alias("rule_no"), F.array_join(inter, ",").alias("matched"))


_RED_P, _RED_P_LAST = redaction_ctes("prompts", "text", "rp")


@register("join_tokens", "2.5", f"""WITH {PROMPTS_CTE}
SELECT request_id, text FROM prompts""")
def join_tokens(spark, sf_dir):
    """Rehydrate redacted responses by joining their tokens to the token child
    table on (request_id, token) instead of a per-row map lookup.  Correct
    rehydration gives back the original text, which is the oracle."""
    red = RD.redact_text(D.prompt_requests(spark, sf_dir), "text")
    toks = red.select("o_orderkey", "request_id", F.explode("tokens").alias("t")).select(
        "o_orderkey", "request_id", F.col("t.token").alias("token"), F.col("t.value").alias("value"))
    resp = red.select("o_orderkey", "request_id", F.col("redacted_text").alias("resp"))
    pat = r"\[[A-Z_]+_\d{4,}\]"
    pieces = resp.select("o_orderkey", "request_id", "resp", F.posexplode_outer(F.split("resp", pat, -1)).alias("pos", "gap"),
                         F.regexp_extract_all("resp", F.lit(pat), 0).alias("found"))
    pieces = pieces.withColumn("token", F.try_element_at("found", (F.col("pos") + 1).cast("int")))
    j = pieces.join(toks, ["o_orderkey", "request_id", "token"], "left")
    filled = F.concat(F.col("gap"), F.coalesce(F.col("value"), F.col("token"), F.lit("")))
    g = j.groupBy("o_orderkey", "request_id").agg(F.array_sort(F.collect_list(F.struct("pos", filled.alias("s")))).alias("a"))
    return g.select("request_id", F.array_join(F.transform("a", lambda x: x["s"]), "").alias("text"))


@register("distinct_values", "2.9", f"""WITH {CORPUS_CTE},
{redaction_ctes("corpus", "text", "dv")[0]},
x AS (SELECT unnest(toks) AS u FROM {redaction_ctes("corpus", "text", "dv")[1]})
SELECT u.entity AS entity, count(DISTINCT u.value) AS n_distinct_values, count(*) AS n_text_values FROM x GROUP BY 1""")
def distinct_values(spark, sf_dir):
    """Corpus-wide distinct entity values per type (the per-text distinct sets
    feed a distinct count; partial aggregation before the shuffle)."""
    red = RD.redact_text(corpus(spark, sf_dir), "text")
    t = red.select(F.explode("tokens").alias("u")).select("u.entity", "u.value")
    return t.groupBy("entity").agg(F.countDistinct("value").alias("n_distinct_values"),
                                   F.count(F.lit(1)).alias("n_text_values"))
