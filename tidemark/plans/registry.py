"""All queries of the engine and their SQL, by name.

The log over ``events`` is described in ``tidemark.sources.changelog``. SQL is
written on its own, not generated from the DataFrame side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import bloom, protocol
from tidemark.operators import layers, lww, quorum
from tidemark.runtime import shared_path
from tidemark.sources import changelog, wal

C = """WITH c AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS key, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op,
  CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value, event_id // 1000 AS segment FROM events)"""
LATEST = C + ", latest AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"
SEGMENTS = C + ", s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY segment, key ORDER BY seq DESC) = 1)"
BYTES = "strlen(key) + coalesce(strlen(value), 0)"
#: 64-bit FNV-1a of ASCII keys, on 128-bit integers.
FNV = """list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i::int, 1))::hugeint)),
  lambda h, b: ((h - (h % 256)) + xor((h % 256)::int, b::int)::hugeint) * 1099511628211 % 18446744073709551616::hugeint)"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def log(spark: SparkSession, d: str) -> DataFrame:
    return changelog.events_log(spark, d)


@query("q01_lww_snapshot", LATEST + " SELECT key, value, seq FROM latest WHERE op = 1")
def q01(spark, d):
    return lww.snapshot(log(spark, d)).select("key", "value", "seq")


@query("q01b_lww_orders", "SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderpriority AS value, o_orderkey AS seq FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) WHERE o_orderstatus <> 'F'")
def q01b(spark, d):
    return lww.snapshot(changelog.orders_log(spark, d)).select("key", "value", "seq")


@query("q01c_lww_lineitem", "SELECT l_orderkey AS key, l_partkey AS value, (CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey) * 100000 + l_suppkey AS seq FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1) WHERE l_returnflag <> 'R'")
def q01c(spark, d):
    return lww.snapshot(changelog.lineitem_log(spark, d)).select("key", "value", "seq")


@query("q02_point_get", LATEST + " SELECT key, op, value, seq FROM latest WHERE key = '42'")
def q02(spark, d):
    return lww.get(changelog.events_log(spark, d, "42", "42"), "42").select("key", "op", "value", "seq")


@query("q04_range_scan", LATEST + " SELECT key, value, seq FROM latest WHERE op = 1 AND key BETWEEN '10' AND '19'")
def q04(spark, d):
    return lww.scan(changelog.events_log(spark, d, "10", "19"), "10", "19").select("key", "value", "seq")


@query("q05_ordered_scan", LATEST + " SELECT key, op, value, seq FROM latest ORDER BY key")
def q05(spark, d):
    return lww.resolve(log(spark, d)).select("key", "op", "value", "seq").orderBy("key")


@query("q06b_read_order", SEGMENTS + " SELECT key, segment, op, value FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY segment DESC) = 1")
def q06b(spark, d):
    entries = layers.segments(log(spark, d)).withColumn("level", F.lit(0))
    return layers.read_order(entries).select("key", "segment", "op", "value")


@query("q06c_compact_oldest_l0", SEGMENTS + " SELECT key, value, seq FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY segment) = 1) WHERE op = 1")
def q06c(spark, d):
    return layers.compact(layers.segments(log(spark, d)), compat="oldest_l0").select("key", "value", "seq")


@query("q07_memtable_bytes", SEGMENTS + f" SELECT segment, CAST(sum({BYTES}) AS BIGINT) AS bytes, count(*) AS n_entries FROM s GROUP BY segment")
def q07(spark, d):
    return layers.segments(log(spark, d)).groupBy("segment").agg(F.sum(layers.entry_bytes()).alias("bytes"), F.count("*").alias("n_entries"))


@query("q07b_flush_boundaries", C + f""" SELECT flush, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_records, CAST(sum(b) AS BIGINT) AS bytes
  FROM (SELECT seq, {BYTES} AS b, CAST(sum({BYTES}) OVER (ORDER BY seq) - ({BYTES}) AS BIGINT) // 4096 AS flush FROM c) GROUP BY flush""")
def q07b(spark, d):
    return layers.flush_boundaries(log(spark, d), 4096)


@query("q08_engine_stats", SEGMENTS + f""", e AS (SELECT segment, count(*) AS n_entries, CAST(sum(CASE WHEN op = 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_tombstones, CAST(sum({BYTES}) AS BIGINT) AS bytes FROM s GROUP BY segment)
  SELECT * FROM e UNION ALL SELECT -1, CAST(sum(n_entries) AS BIGINT), CAST(sum(n_tombstones) AS BIGINT), CAST(sum(bytes) AS BIGINT) FROM e""")
def q08(spark, d):
    return layers.stats(layers.segments(log(spark, d)))


INDEX = "SELECT segment, key, place FROM (SELECT o_orderkey // 4096 AS segment, o_orderkey AS key, row_number() OVER (PARTITION BY o_orderkey // 4096 ORDER BY o_orderkey) - 1 AS place FROM orders) WHERE place % 16 = 0"


def _orders_index(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return layers.sparse_index(orders.select(F.expr("o_orderkey div 4096").alias("segment"), F.col("o_orderkey").alias("key")))


@query("q09_sparse_index", INDEX.replace("place FROM (", "CAST(place AS INTEGER) AS place FROM (", 1))
def q09(spark, d):
    return _orders_index(spark, d)


BITS = C + f""", k AS (SELECT DISTINCT segment, key FROM c), n AS (SELECT segment, count(*) AS n_keys, greatest(64, 10 * count(*)) AS m FROM k GROUP BY segment),
  h AS (SELECT segment, key, {FNV} AS h FROM k), x AS (SELECT h.segment, key, n_keys, m, h % 4294967296 AS a, (h // 4294967296) + CASE WHEN (h // 4294967296) % 2 = 0 THEN 1 ELSE 0 END AS b FROM h JOIN n ON n.segment = h.segment),
  bits AS (SELECT DISTINCT segment, n_keys, m, CAST(((a + i * b) % 4294967296) % m AS BIGINT) AS bit FROM x, range(0, 6) t(i))"""


@query("q10_bloom_build", BITS + " SELECT segment, n_keys, m AS num_bits, count(*) AS set_bits, CAST(sum(bit) AS BIGINT) AS position_sum FROM bits GROUP BY segment, n_keys, m")
def q10(spark, d):
    w = bloom.build_words(log(spark, d)).withColumn("at", bloom.set_places(F.col("word"), F.col("mask")))
    total = F.aggregate("at", F.lit(0).cast("long"), lambda a, b: a + b)
    return w.groupBy("segment", "n_keys", "num_bits").agg(F.sum(F.size("at").cast("long")).alias("set_bits"), F.sum(total).alias("position_sum"))


@query("q11_bloom_sizing", C + """ SELECT segment, per_key, n_keys, m AS num_bits, CAST(k AS INTEGER) AS num_hash, round(pow(1 - exp(-k::double * n_keys::double / m::double), k::double), 9) AS fpr
  FROM (SELECT segment, CAST(per_key AS INTEGER) AS per_key, n_keys, greatest(64, n_keys * per_key) AS m, CASE per_key WHEN 3 THEN 2 WHEN 5 THEN 3 WHEN 10 THEN 6 ELSE 10 END AS k
    FROM (SELECT segment, count(DISTINCT key) AS n_keys FROM c GROUP BY segment), (VALUES (3), (5), (10), (15)) v(per_key))""")
def q11(spark, d):
    n = log(spark, d).groupBy("segment").agg(F.countDistinct("key").alias("n_keys"))
    each = n.select("segment", F.explode(F.array(*(F.lit(x) for x in (3, 5, 10, 15)))).alias("per_key"), "n_keys")
    sized = each.withColumn("num_bits", bloom.num_bits(F.col("n_keys"), F.col("per_key"))).withColumn("num_hash", bloom.num_hashes(F.col("per_key")))
    return sized.withColumn("fpr", F.round(bloom.false_positive_rate(F.col("n_keys"), F.col("num_bits"), F.col("num_hash")), 9))


#: CRC-32 of a list b of bytes, by a table t of 256 numbers made from the polynomial.
CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda c, b: xor(c // 256, t[1 + (xor(c, b) % 256)::INT])), 4294967295::UBIGINT)"""
LE32 = "[({0})::UBIGINT % 256, ({0})::UBIGINT // 256 % 256, ({0})::UBIGINT // 65536 % 256, ({0})::UBIGINT // 16777216 % 256]"
OCTETS = "list_transform(range(1, strlen({0}) + 1), lambda i: ascii(substr({0}, i::INT, 1))::UBIGINT)"


@query("q12_wal_crc", C + f""", crc AS (SELECT list(list_reduce(list_prepend(n::UBIGINT, range(8)::UBIGINT[]), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) ORDER BY n) AS t FROM range(256) r(n)),
  b AS (SELECT seq, list_concat(list_concat(list_concat([op::UBIGINT], {LE32.format('strlen(key)')}), {OCTETS.format('key')}), list_concat({LE32.format("strlen(coalesce(value, ''))")}, {OCTETS.format("coalesce(value, '')")})) AS b FROM c)
  SELECT seq, CAST({CRC} AS BIGINT) AS crc, CAST(len(b) + 8 AS BIGINT) AS frame_bytes FROM b, crc""")
def q12(spark, d):
    p = wal.payload(F.col("op"), F.col("key"), F.col("value"))
    return log(spark, d).select("seq", F.crc32(p).alias("crc"), (F.octet_length(p) + 8).cast("long").alias("frame_bytes"))


@query("q13_wal_replay", C + " SELECT segment, seq % 1000 AS frame_no, key, op, value FROM c WHERE segment % 2 = 0 OR seq % 1000 < 700")
def q13(spark, d):
    """Logs of one segment each; in every second one a byte of record 700 is damaged, so that replay ends before it."""
    framed = log(spark, d).withColumn("frame", wal.frame(F.col("op"), F.col("key"), F.col("value")))
    bad = F.concat(F.substring("frame", F.lit(1), F.octet_length("frame") - 1), F.unhex(F.lit("ff")))
    damaged = framed.withColumn("frame", F.when((F.col("segment") % 2 == 1) & (F.expr("seq % 1000") == 700), bad).otherwise(F.col("frame")))
    files = damaged.groupBy("segment").agg(F.sort_array(F.collect_list(F.struct("seq", "frame"))).alias("f"))
    joined = F.unhex(F.array_join(F.transform("f", lambda x: F.hex(x["frame"])), ""))  # one concatenation, whatever the log's length
    replayed = wal.replay(files.select(F.col("segment").cast("string").alias("path"), joined.alias("content")))
    return replayed.select(F.col("path").cast("long").alias("segment"), "frame_no", "key", "op", F.decode("value", "UTF-8").alias("value"))


@query("q14_command_codec", C + """ SELECT seq, '{"type":' || op || ',"key":"' || key || '"' || CASE WHEN op = 1 THEN ',"value":"' || base64(encode(value)) || '"' ELSE '' END || '}' AS command, op, key, value FROM c""")
def q14(spark, d):
    text = log(spark, d).select("seq", protocol.encode_command(F.col("op"), F.col("key"), F.col("value")).alias("command"))
    c = protocol.decode_command(F.col("command"))
    return text.select("seq", "command", c["op"].alias("op"), c["key"].alias("key"), c["value"].alias("value"))


@query("q14b_http_eval", C + """ SELECT r.event_id AS seq, CASE WHEN r.key = '' THEN 400 WHEN r.method = 'GET' THEN CASE WHEN l.op = 1 THEN 200 ELSE 404 END WHEN r.method = 'PUT' THEN CASE WHEN r.event_id % 11 = 0 THEN 400 WHEN r.event_id % 7 = 0 THEN 503 ELSE 200 END
  WHEN r.method = 'DELETE' THEN CASE WHEN r.event_id % 7 = 0 THEN 503 ELSE 200 END ELSE 405 END AS code
  FROM (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS key, CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'PUT' WHEN 'purchase' THEN 'PUT' WHEN 'error' THEN 'DELETE' ELSE 'PATCH' END AS method FROM events) r
  LEFT JOIN (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) l ON l.key = r.key""")
def q14b(spark, d):
    """Requests made from events, answered against the last state. Some have no key, some a bad body, some meet no leader."""
    e, i = spark.read.parquet(f"{d}/events.parquet"), F.col("event_id")
    method = F.when(F.col("event_type") == "view", "GET").when(F.col("event_type").isin("click", "purchase"), "PUT").when(F.col("event_type") == "error", "DELETE").otherwise("PATCH")
    path = F.concat(F.lit(protocol.PREFIX), F.when(i % 13 == 0, "").otherwise(F.col("user_id").cast("string")))
    body = F.when(i % 11 == 0, F.when(i % 2 == 0, '{"value": 3}').otherwise("{")).otherwise(F.to_json(F.struct(F.col("props").alias("value"))))
    r = e.select(i.alias("seq"), method.alias("method"), protocol.path_key(path).alias("key"), body.alias("body"), (i % 7 != 0).alias("leader"))
    found = lww.resolve(log(spark, d)).select("key", F.col("op").alias("found_op"))
    ok, _ = protocol.body_value(F.col("body"))
    hit = F.coalesce(F.col("found_op") == 1, F.lit(False))
    return r.join(found, "key", "left").select("seq", protocol.status_code(F.col("method"), F.col("key"), hit, ok, F.col("leader")).alias("code"))


@query("q16_bloom_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def q16(spark, d):
    """Customers with an open order. For large sides the optimizer puts its own Bloom filter before the shuffle; the semi join is exact."""
    customers, orders = spark.read.parquet(f"{d}/customer.parquet"), spark.read.parquet(f"{d}/orders.parquet")
    wanted = orders.where("o_orderstatus = 'P'")
    return customers.join(wanted, customers["c_custkey"] == wanted["o_custkey"], "left_semi").select("c_custkey", "c_name")


@query("q17_cli_parse", """SELECT seq, command, key, value, usage_ok FROM (SELECT seq, command, key, value, CASE command WHEN 'put' THEN value IS NOT NULL WHEN 'get' THEN key IS NOT NULL WHEN 'del' THEN key IS NOT NULL ELSE command IN ('status', 'help', 'exit') END AS usage_ok
  FROM (SELECT event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'put' WHEN 1 THEN 'get' WHEN 2 THEN 'del' WHEN 3 THEN 'status' ELSE 'nonsense' END AS command, CASE WHEN event_id % 5 < 3 AND event_id % 3 > 0 THEN CAST(user_id AS VARCHAR) END AS key, CASE WHEN event_id % 5 = 0 AND event_id % 3 = 2 THEN props END AS value FROM events))""")
def q17(spark, d):
    e, i = spark.read.parquet(f"{d}/events.parquet"), F.col("event_id")
    word = F.element_at(F.array(*(F.lit(x) for x in ("PUT", "Get", "delete", "STATUS", "nonsense"))), (i % 5 + 1).cast("int"))
    key = F.when((i % 5 < 3) & (i % 3 > 0), F.concat(F.lit(" "), F.col("user_id").cast("string")))
    value = F.when((i % 5 == 0) & (i % 3 == 2), F.concat(F.lit(" "), F.col("props")))
    line = F.concat(F.lit("  "), word, F.coalesce(key, F.lit("")), F.coalesce(value, F.lit("")), F.lit(" "))
    return protocol.parse_line(e.select(i.alias("seq"), line.alias("line"))).drop("line")


@query("q18_replay_idempotent", "SELECT CAST(0 AS BIGINT) AS n_different")
def q18(spark, d):
    c = log(spark, d)
    return lww.difference(lww.snapshot(c.unionByName(c)), lww.snapshot(c))


@query("q19_election_tally", """SELECT term, candidate, n_votes, n_votes >= 3 AS elected FROM (SELECT event_id // 20 AS term, event_id % 3 AS candidate, count(DISTINCT user_id % 5) AS n_votes FROM events WHERE event_type <> 'error' GROUP BY 1, 2)""")
def q19(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    votes = e.select(F.expr("event_id div 20").alias("term"), F.expr("event_id % 3").alias("candidate"), F.expr("user_id % 5").alias("voter"), (F.col("event_type") != "error").alias("granted"))
    return quorum.tally(votes, 5)


@query("q20_commit_index", C + """, l AS (SELECT segment AS leader, max(seq) AS last_idx, (max(seq) // 600) * 600 AS term_start, min(seq) AS committed FROM c GROUP BY 1),
  m AS (SELECT segment AS leader, CAST(key AS BIGINT) % 4 AS peer, max(seq) AS m FROM c WHERE seq % 1000 < 300 + 200 * (CAST(key AS BIGINT) % 4) GROUP BY 1, 2), a AS (SELECT leader, m FROM m UNION ALL SELECT leader, last_idx FROM l),
  r AS (SELECT leader, list_sort(list(m), 'DESC')[count(*) // 2 + 1] AS reached FROM a GROUP BY leader)
  SELECT l.leader, CASE WHEN reached >= term_start AND reached > committed THEN reached ELSE committed END AS commit_idx FROM l JOIN r ON r.leader = l.leader""")
def q20(spark, d):
    c, peer = log(spark, d), F.col("key").cast("long") % 4
    leaders = c.groupBy(F.col("segment").alias("leader")).agg(F.max("seq").alias("last_idx"), F.expr("(max(seq) div 600) * 600").alias("term_start"), F.min("seq").alias("committed"))
    acks = c.where(F.expr("seq % 1000") < 300 + 200 * peer).select(F.col("segment").alias("leader"), peer.alias("peer"), F.col("seq").alias("match_idx"))
    return quorum.commit_index(acks, leaders)


@query("q21_log_conflict", """WITH a AS (SELECT event_id // 500 AS log, event_id AS idx, event_id // 300 AS term FROM events), b AS (SELECT log, idx, CASE WHEN idx % 500 > 400 - 13 * (log % 20) AND log % 3 > 0 THEN term + 1 ELSE term END AS term FROM a WHERE log % 4 > 0 OR idx % 500 < 450)
  SELECT log, first_conflict, coalesce(first_conflict - 1, last) AS matched FROM (SELECT coalesce(a.log, b.log) AS log, min(CASE WHEN a.term IS DISTINCT FROM b.term THEN coalesce(a.idx, b.idx) END) AS first_conflict, max(coalesce(a.idx, b.idx)) AS last FROM a FULL OUTER JOIN b ON a.log = b.log AND a.idx = b.idx GROUP BY 1)""")
def q21(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    a = e.select(F.expr("event_id div 500").alias("log"), F.col("event_id").alias("idx"), F.expr("event_id div 300").alias("term"))
    changed = F.expr("idx % 500 > 400 - 13 * (log % 20) and log % 3 > 0")
    b = a.where("log % 4 > 0 or idx % 500 < 450").withColumn("term", F.when(changed, F.col("term") + 1).otherwise(F.col("term")))
    return quorum.conflicts(a, b)


@query("q22_vote_grant", """SELECT event_id AS seq, term >= current_term AND (term > current_term OR voted_for IS NULL OR voted_for = candidate) AND (t > mt OR (t = mt AND i >= mi)) AS granted, greatest(term, current_term) AS reply_term
  FROM (SELECT event_id, event_id % 5 + 3 AS term, user_id % 6 + 3 AS current_term, CASE WHEN user_id % 4 > 0 THEN user_id % 3 END AS voted_for, event_id % 3 AS candidate, event_id % 4 AS t, event_id % 9 AS i, user_id % 4 AS mt, user_id % 9 AS mi FROM events)""")
def q22(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    r = e.selectExpr("event_id as seq", "event_id % 5 + 3 as term", "user_id % 6 + 3 as current_term", "case when user_id % 4 > 0 then user_id % 3 end as voted_for", "event_id % 3 as candidate", "event_id % 4 as last_log_term", "event_id % 9 as last_log_idx", "user_id % 4 as my_last_term", "user_id % 9 as my_last_idx")
    return quorum.grant(r).select("seq", "granted", "reply_term")


@query("q23_append_result", """SELECT seq, success, CASE WHEN success THEN greatest(commit, least(leader_commit, prev_idx + n_entries)) ELSE commit END AS new_commit, CASE WHEN success THEN prev_idx + n_entries + 1 WHEN match_idx + 1 < next_idx THEN match_idx + 1 ELSE greatest(next_idx - 1, 1) END AS new_next
  FROM (SELECT *, term >= current_term AND (prev_idx = 0 OR coalesce(my_prev_term = prev_term, false)) AS success FROM (SELECT event_id AS seq, event_id % 5 + 2 AS term, user_id % 4 + 2 AS current_term, event_id % 50 AS prev_idx, event_id % 3 AS prev_term, CASE WHEN user_id % 7 > 0 THEN user_id % 3 END AS my_prev_term,
    event_id % 4 AS n_entries, user_id % 60 AS leader_commit, user_id % 30 AS commit, event_id % 50 + 1 AS next_idx, user_id % 40 AS match_idx FROM events))""")
def q23(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    r = e.selectExpr("event_id as seq", "event_id % 5 + 2 as term", "user_id % 4 + 2 as current_term", "event_id % 50 as prev_idx", "event_id % 3 as prev_term", "case when user_id % 7 > 0 then user_id % 3 end as my_prev_term", "event_id % 4 as n_entries", "user_id % 60 as leader_commit", "user_id % 30 as commit", "event_id % 50 + 1 as next_idx", "user_id % 40 as match_idx")
    return quorum.append_result(r).select("seq", "success", "new_commit", "new_next")


@query("q25_stream_apply", LATEST + " SELECT key, value, seq FROM latest WHERE op = 1")
def q25(spark, d):
    """The log cut into files in an order that is not that of seq, read as a stream; what is left live at its end."""
    from tidemark.streaming import apply

    source = shared_path(spark, "stream-log")
    log(spark, d).repartition(6, F.xxhash64("seq")).write.parquet(source)
    name = "applied_" + source.rsplit("-", 1)[1]
    apply.start_state(apply.events_stream(spark, source), name, shared_path(spark, "stream-state")).awaitTermination()
    return spark.table(name).where("op = 1").select("key", "value", "seq")


@query("q26_tombstone_stats", LATEST + " SELECT live, tombstones, versions - live - tombstones AS shadowed, versions, round(versions::double / live, 6) AS amplification FROM (SELECT CAST(count(*) FILTER (op = 1) AS BIGINT) AS live, CAST(count(*) FILTER (op = 2) AS BIGINT) AS tombstones, (SELECT count(*) FROM c) AS versions FROM latest)")
def q26(spark, d):
    return layers.space(log(spark, d))


@query("q27_version_history", C + " SELECT key, seq, op, value, CAST(lead(seq) OVER (PARTITION BY key ORDER BY seq) AS BIGINT) AS next_seq, CAST(row_number() OVER (PARTITION BY key ORDER BY seq) AS INTEGER) AS version FROM c")
def q27(spark, d):
    return lww.history(log(spark, d)).select("key", "seq", "op", "value", "next_seq", "version")


@query("q28_as_of_snapshot", C + " SELECT key, value, seq FROM (SELECT * FROM c WHERE seq <= 700 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op = 1")
def q28(spark, d):
    return lww.as_of(log(spark, d), 700).select("key", "value", "seq")


@query("q29_store_roundtrip", LATEST + " SELECT key, value, seq FROM latest WHERE op = 1")
def q29(spark, d):
    """The log written through a store in four parts, flushed and compacted: what a reader then sees."""
    from tidemark.operators.store import Store

    store = Store(spark, shared_path(spark, "store"))
    rows = log(spark, d)
    for part in range(4):
        store.ingest(rows.where(F.expr(f"seq % 4 = {part}")))
    store.compact()
    return store.snapshot().select("key", F.decode("value", "UTF-8").alias("value"), "seq")


@query("q30_enum_names", "SELECT event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'Follower' WHEN 1 THEN 'Candidate' WHEN 2 THEN 'Leader' ELSE 'Unknown' END AS state, lpad(CAST(event_id AS VARCHAR), 20, '0') AS name, ':' || (user_id + 1000) AS address FROM events")
def q30(spark, d):
    e, i = spark.read.parquet(f"{d}/events.parquet"), F.col("event_id")
    state = F.when(i % 4 == 0, "Follower").when(i % 4 == 1, "Candidate").when(i % 4 == 2, "Leader").otherwise("Unknown")
    return e.select(i.alias("seq"), state.alias("state"), F.format_string("%020d", i).alias("name"), F.concat(F.lit(":"), (F.col("user_id") + 1000).cast("string")).alias("address"))


@query("q07c_exact_flushes", C.replace("WITH c", "WITH RECURSIVE c", 1) + f""", k AS (SELECT CAST(key AS BIGINT) % 8 AS store, seq, key, {BYTES} AS b FROM c),
  e AS (SELECT store, seq, b, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS prev, lag(b) OVER (PARTITION BY key ORDER BY seq) AS was, lead(seq) OVER (PARTITION BY store ORDER BY seq) AS nxt FROM k),
  f AS (SELECT store, CAST(-1 AS BIGINT) AS flush, CAST(NULL AS BIGINT) AS first_seq, CAST(NULL AS BIGINT) AS last_seq, CAST(0 AS BIGINT) AS n_keys, CAST(0 AS BIGINT) AS bytes, min(seq) AS start FROM k GROUP BY store
  UNION ALL SELECT store, flush + 1, start, seq, n, run, nxt FROM (SELECT *, row_number() OVER (PARTITION BY store ORDER BY run >= 1024 DESC, CASE WHEN run >= 1024 THEN seq ELSE -seq END) AS r FROM (
    SELECT f.store, f.flush, f.start, e.seq, e.nxt, CAST(sum(CASE WHEN e.prev >= f.start THEN e.b - e.was ELSE e.b END) OVER w AS BIGINT) AS run, CAST(sum(CASE WHEN e.prev >= f.start THEN 0 ELSE 1 END) OVER w AS BIGINT) AS n
    FROM f JOIN e ON e.store = f.store AND e.seq >= f.start WINDOW w AS (PARTITION BY f.store ORDER BY e.seq))) WHERE r = 1)
  SELECT store, flush, first_seq, last_seq, n_keys, bytes FROM f WHERE flush >= 0""")
def q07c(spark, d):
    """Overwrite-aware memtables, for eight stores that share the log by user."""
    return layers.exact_flushes(log(spark, d).withColumn("store", F.col("key").cast("long") % 8), 1024)


@query("q32_become_leader", "SELECT leader, peer, max_idx + 1 AS next_idx, CAST(0 AS BIGINT) AS match_idx FROM (SELECT user_id AS leader, max(event_id) AS max_idx FROM events GROUP BY 1), (SELECT range AS peer FROM range(1, 5))")
def q32(spark, d):
    leaders = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("leader")).agg(F.max("event_id").alias("last_idx"))
    peer_ids = leaders.select("leader", F.explode(F.expr("sequence(1L, 4L)")).alias("peer"))
    return quorum.become_leader(leaders, peer_ids)


@query("q33_step_down", """SELECT event_id AS node, CASE WHEN seen > cur THEN 'Follower' ELSE st END AS state, greatest(seen, cur) AS current_term, CASE WHEN seen > cur THEN NULL ELSE vf END AS voted_for
  FROM (SELECT event_id, event_id % 7 AS seen, user_id % 6 AS cur, CASE WHEN event_id % 2 = 0 THEN 'Leader' ELSE 'Candidate' END AS st, user_id % 3 AS vf FROM events)""")
def q33(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return quorum.step_down(e.selectExpr("event_id as node", "event_id % 7 as seen_term", "user_id % 6 as current_term", "if(event_id % 2 = 0, 'Leader', 'Candidate') as state", "user_id % 3 as voted_for"))


@query("q33b_start_election", "SELECT event_id AS node, 'Candidate' AS state, user_id % 6 + 1 AS current_term, event_id AS voted_for FROM events")
def q33b(spark, d):
    return quorum.start_election(spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id as node", "user_id % 6 as current_term"))


@query("q34_replication_suffix", """SELECT p.leader, p.peer, p.next_idx - 1 AS prev_idx, (SELECT count(*) FROM events e WHERE e.event_id // 500 = p.leader AND e.event_id >= p.next_idx) AS n_entries
  FROM (SELECT DISTINCT event_id // 500 AS leader, user_id % 3 AS peer, (event_id // 500) * 500 + 100 * (user_id % 3) + 50 AS next_idx FROM events) p""")
def q34(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    progress = e.selectExpr("event_id div 500 as leader", "user_id % 3 as peer", "(event_id div 500) * 500 + 100 * (user_id % 3) + 50 as next_idx").distinct()
    return quorum.to_send(e.selectExpr("event_id div 500 as leader", "event_id as idx"), progress)


APPEND = """WITH a AS (SELECT event_id // 500 AS log, event_id AS idx, event_id // 300 AS term FROM events WHERE event_id % 500 < 400), b AS (SELECT event_id // 500 AS log, event_id AS idx, event_id // 300 + CASE WHEN event_id % 500 > 350 AND event_id // 500 % 2 = 0 THEN 1 ELSE 0 END AS term FROM events WHERE event_id % 500 >= 300),
  cut AS (SELECT a.log, min(a.idx) AS cut FROM a JOIN b ON a.log = b.log AND a.idx = b.idx WHERE a.term <> b.term GROUP BY 1), kept AS (SELECT a.* FROM a LEFT JOIN cut ON cut.log = a.log WHERE cut IS NULL OR idx < cut)"""


@query("q35_append_entries", APPEND + " SELECT * FROM kept UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.log = b.log AND k.idx = b.idx)")
def q35(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id div 500 as log", "event_id as idx", "event_id div 300 as term")
    new = e.where("idx % 500 >= 300").withColumn("term", F.expr("term + if(idx % 500 > 350 and log % 2 = 0, 1, 0)"))
    return quorum.append_entries(e.where("idx % 500 < 400"), new)


@query("q36_propose", """SELECT event_id AS seq, user_id AS node, user_id % 3 = 0 AS accepted, CASE WHEN user_id % 3 = 0 THEN 1000 + row_number() OVER (PARTITION BY user_id ORDER BY event_id) END AS idx, user_id % 3 AS leader FROM events""")
def q36(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    nodes = e.selectExpr("user_id as node", "if(user_id % 3 = 0, 'Leader', 'Follower') as state", "1000L as last_idx", "user_id % 3 as leader").distinct()
    return quorum.propose(e.selectExpr("event_id as seq", "user_id as node"), nodes)


@query("q37_election_timeouts", """SELECT s_suppkey, 300 + CAST(CAST('0x' || substr(md5('7:' || s_suppkey), 1, 8) AS BIGINT) * 200 AS DOUBLE) / CAST(4294967296 AS DOUBLE) AS timeout_ms FROM supplier""")
def q37(spark, d):
    """Timeouts of 300 to 500 ms; seed and node decide, not the partitions."""
    return spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", quorum.election_timeout(F.col("s_suppkey"), 7).alias("timeout_ms"))


#: Every user and ten ids after the last one, which have no log.
PROBES = "(SELECT DISTINCT user_id AS id FROM events UNION SELECT m + range FROM (SELECT max(user_id) AS m FROM events), range(1, 11))"


def _probes(spark, d):
    users = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("long").alias("id"))
    absent = users.agg(F.max("id").alias("m")).select(F.explode(F.sequence(F.col("m") + 1, F.col("m") + 10)).alias("id"))
    return users.distinct().unionByName(absent)


def _probe_keys(spark, d):
    return _probes(spark, d).select(F.col("id").cast("string").alias("key"))


@query("q03b_batch_get_all", LATEST + f""" SELECT k.key, CASE WHEN l.op IS NULL THEN 'absent' WHEN l.op = 1 THEN 'hit' ELSE 'deleted' END AS state, CASE WHEN l.op = 1 THEN l.value END AS value
  FROM (SELECT CAST(id AS VARCHAR) AS key FROM {PROBES}) k LEFT JOIN latest l ON l.key = k.key""")
def q03b(spark, d):
    return lww.batch_get(log(spark, d), _probe_keys(spark, d))


@query("q10c_bloom_probe_all", BITS + f""", p AS (SELECT n.segment, CAST(r.id AS VARCHAR) AS key, n.m FROM n, {PROBES} r), ph AS (SELECT segment, key, m, {FNV} AS h FROM p),
  pb AS (SELECT segment, key, CAST(((h % 4294967296 + i * ((h // 4294967296) + CASE WHEN (h // 4294967296) % 2 = 0 THEN 1 ELSE 0 END)) % 4294967296) % m AS BIGINT) AS bit FROM ph, range(0, 6) t(i))
  SELECT pb.segment, pb.key, bool_and(b.bit IS NOT NULL) AS maybe FROM pb LEFT JOIN bits b ON b.segment = pb.segment AND b.bit = pb.bit GROUP BY pb.segment, pb.key""")
def q10c(spark, d):
    return bloom.probe_all(log(spark, d), _probe_keys(spark, d))


@query("q15b_missing_keys_all", C + f" SELECT CAST(id AS VARCHAR) AS key FROM {PROBES} r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.key = CAST(r.id AS VARCHAR))")
def q15b(spark, d):
    return lww.missing(log(spark, d), _probe_keys(spark, d))


@query("q31b_last_entries_all", f"""SELECT n.id AS node, coalesce(l.last_idx, 0) AS last_idx, coalesce(l.last_term, 0) AS last_term, coalesce(l.length, 0) AS length FROM {PROBES} n
  LEFT JOIN (SELECT user_id AS node, max(event_id) AS last_idx, arg_max(event_id // 300, event_id) AS last_term, count(*) AS length FROM events GROUP BY 1) l ON l.node = n.id""")
def q31b(spark, d):
    entries = spark.read.parquet(f"{d}/events.parquet").selectExpr("user_id as node", "event_id as idx", "event_id div 300 as term")
    return quorum.last_entries(entries, _probes(spark, d).select(F.col("id").alias("node")))


@query("q06e_compact_all", LATEST + " SELECT key, value, seq FROM latest WHERE op = 1")
def q06e(spark, d):
    return layers.compact(layers.segments(log(spark, d))).select("key", "value", "seq")


@query("q06f_compact_keep_tombstones", LATEST + " SELECT key, op, value, seq FROM latest")
def q06f(spark, d):
    """All segments merged as if lower data were left: tombstones stay."""
    return layers.compact(layers.segments(log(spark, d)), full=False).select("key", "op", "value", "seq")


@query("q09c_index_seek_all", f"""WITH i AS ({INDEX}), p AS (SELECT o_orderkey // 4096 AS segment, o_orderkey AS probe FROM orders)
  SELECT p.segment, p.probe, max(CASE WHEN i.key <= p.probe THEN i.key END) AS first_key FROM p JOIN i ON i.segment = p.segment GROUP BY 1, 2""")
def q09c(spark, d):
    probes = spark.read.parquet(f"{d}/orders.parquet").select(F.expr("o_orderkey div 4096").alias("segment"), F.col("o_orderkey").alias("probe"))
    return layers.index_seek(_orders_index(spark, d), probes)


@query("q24b_peer_map_all", """SELECT (s - 1) % 5 + 1 AS node, CAST(i + CASE WHEN i >= (s - 1) % 5 + 1 THEN 1 ELSE 0 END AS BIGINT) AS peer_id, ':' || (8000 + 10 * s + i) AS address FROM (SELECT s_suppkey AS s FROM supplier), range(1, 5) t(i)""")
def q24b(spark, d):
    """All suppliers, in groups of five nodes; the address tells the group."""
    s = F.col("s_suppkey")
    listed = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.lit(":"), (8000 + 10 * s + i).cast("string"))), " , ")
    return quorum.peers(spark.read.parquet(f"{d}/supplier.parquet").select(((s - 1) % 5 + 1).alias("node"), listed.alias("peers")))


@query("q16b_bloom_prefilter", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def q16b(spark, d):
    """The same customers by a Bloom filter of the orders' keys, which drops most others before the exact join."""
    customers, orders = spark.read.parquet(f"{d}/customer.parquet"), spark.read.parquet(f"{d}/orders.parquet")
    wanted = orders.where("o_orderstatus = 'P'").select(F.lit(0).cast("long").alias("segment"), F.col("o_custkey").cast("string").alias("key"))
    asked = customers.select(F.lit(0).cast("long").alias("segment"), F.col("c_custkey").cast("string").alias("key"))
    maybe = bloom.probe_words(bloom.build_words(wanted), asked).where("maybe").select("key")
    kept = customers.withColumn("key", F.col("c_custkey").cast("string")).join(maybe, "key", "left_semi")
    return kept.join(wanted, "key", "left_semi").select("c_custkey", "c_name")


@query("q23b_append_commit", """SELECT seq, CASE WHEN ok THEN greatest(commit, least(leader_commit, CASE WHEN conflict THEN prev_idx + n_entries ELSE greatest(my_last_idx, prev_idx + n_entries) END)) ELSE commit END AS new_commit
  FROM (SELECT *, prev_idx = 0 OR prev_idx <= my_last_idx AS ok FROM (SELECT event_id AS seq, event_id % 50 AS prev_idx, event_id % 4 AS n_entries, user_id % 60 AS leader_commit, user_id % 30 AS commit, user_id % 70 AS my_last_idx, event_id % 5 = 0 AS conflict FROM events))""")
def q23b(spark, d):
    """The commit bound of followers whose log may be longer than what a request brings."""
    e = spark.read.parquet(f"{d}/events.parquet")
    r = e.selectExpr("event_id as seq", "1 as term", "1 as current_term", "event_id % 50 as prev_idx", "1 as prev_term", "if(event_id % 50 <= user_id % 70, 1, null) as my_prev_term", "event_id % 4 as n_entries", "user_id % 60 as leader_commit", "user_id % 30 as commit", "1L as next_idx", "0L as match_idx", "user_id % 70 as my_last_idx", "event_id % 5 = 0 as conflict")
    return quorum.append_result(r).select("seq", "new_commit")


CHECKED = """WITH a AS (SELECT event_id // 500 AS log, event_id AS idx, event_id // 300 AS term FROM events WHERE event_id % 500 < 400 - 40 * (event_id // 500 % 3)),
  r AS (SELECT DISTINCT event_id // 500 AS log, event_id // 500 * 500 + 349 AS prev_idx, (event_id // 500 * 500 + 349) // 300 + event_id // 500 % 2 AS prev_term FROM events),
  j AS (SELECT r.log, r.prev_idx, a.term AS mine, coalesce(a.term = r.prev_term, false) AS ok FROM r LEFT JOIN a ON a.log = r.log AND a.idx = r.prev_idx),
  kept AS (SELECT a.* FROM a LEFT JOIN j ON j.log = a.log WHERE j.log IS NULL OR j.ok OR j.mine IS NULL OR a.idx < j.prev_idx),
  e AS (SELECT event_id // 500 AS log, event_id AS idx, event_id // 300 + CASE WHEN event_id % 500 > 380 THEN 1 ELSE 0 END AS term FROM events WHERE event_id % 500 >= 350 AND event_id // 500 IN (SELECT log FROM j WHERE ok)),
  cut AS (SELECT kept.log, min(kept.idx) AS cut FROM kept JOIN e ON e.log = kept.log AND e.idx = kept.idx WHERE e.term <> kept.term GROUP BY 1), rest AS (SELECT kept.* FROM kept LEFT JOIN cut ON cut.log = kept.log WHERE cut IS NULL OR idx < cut)"""


@query("q35b_append_checked", CHECKED + " SELECT log, idx, term FROM rest UNION ALL SELECT log, idx, term FROM e WHERE NOT EXISTS (SELECT 1 FROM rest WHERE rest.log = e.log AND rest.idx = e.idx)")
def q35b(spark, d):
    """Followers' logs after requests of which every second one names another term before its entries: those logs are cut there."""
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id div 500 as log", "event_id as idx", "event_id div 300 as term")
    requests = e.select("log").distinct().selectExpr("log", "log * 500 + 349 as prev_idx", "(log * 500 + 349) div 300 + log % 2 as prev_term")
    new = e.where("idx % 500 >= 350").withColumn("term", F.expr("term + if(idx % 500 > 380, 1, 0)"))
    return quorum.append_checked(e.where("idx % 500 < 400 - 40 * (log % 3)"), requests, new)


@query("q38_node_status", SEGMENTS + f""", n AS (SELECT user_id AS node, count(*) AS log_length, max(event_id) AS last FROM events GROUP BY 1), s2 AS (SELECT CAST(key AS BIGINT) AS node, segment, count(*) AS entries, CAST(sum({BYTES}) AS BIGINT) AS bytes FROM s GROUP BY 1, 2), newest AS (SELECT max(segment) AS m FROM s)
  SELECT n.node AS node_id, CASE last % 3 WHEN 0 THEN 'Follower' WHEN 1 THEN 'Candidate' ELSE 'Leader' END AS state, last // 300 AS term, last % 3 = 2 AS is_leader, last % 5 AS leader_id, log_length,
  coalesce(sum(entries) FILTER (segment = m), 0)::BIGINT AS memtable_entries, coalesce(sum(bytes) FILTER (segment = m), 0)::BIGINT AS memtable_bytes, coalesce(sum(entries) FILTER (segment = m - 1), 0)::BIGINT AS immutable_entries,
  count(*) FILTER (segment < m - 1) AS sstable_count, coalesce(sum(entries) FILTER (segment < m - 1), 0)::BIGINT AS total_sstable_entries FROM n JOIN s2 ON s2.node = n.node, newest GROUP BY n.node, last, log_length""")
def q38(spark, d):
    """A status row for each user as a node: the newest segment is its memtable, the one before it the immutable one, the rest its tables."""
    e = spark.read.parquet(f"{d}/events.parquet")
    last = F.max("event_id")
    nodes = e.groupBy(F.col("user_id").alias("node")).agg(last.alias("last")).selectExpr("node", "case last % 3 when 0 then 'Follower' when 1 then 'Candidate' else 'Leader' end as state", "last div 300 as current_term", "last % 5 as leader")
    entries = layers.segments(log(spark, d)).select(F.col("key").cast("long").alias("node"), "segment", layers.entry_bytes().alias("b"))
    each = entries.groupBy("node", "segment").agg(F.count("*").alias("entries"), F.sum("b").alias("bytes"))
    newest = F.broadcast(entries.agg(F.max("segment").alias("m")))  # one row
    kind = F.expr("case when segment = m then 'memtable' when segment = m - 1 then 'immutable' else 'segment' end")
    tables = each.join(newest).select("node", kind.alias("kind"), F.col("segment").alias("table"), "entries", "bytes")
    return quorum.status(nodes, e.select(F.col("user_id").alias("node"), F.col("event_id").alias("idx")), tables)


@query("q39_store_writes", "SELECT * FROM (VALUES ('a', 'hit', '1x'), ('b', 'deleted', NULL), ('c', 'hit', ''), ('d', 'absent', NULL), ('e', 'hit', '9')) v(key, state, value)")
def q39(spark, d):
    """Puts and deletes through a store that is flushed, closed and opened again between them; then five keys are read one by one."""
    from tidemark.operators.store import Store

    home = shared_path(spark, "store")
    store = Store(spark, home)
    for key, value in (("a", "0"), ("b", "2"), ("c", "3")):
        store.put(key, value)
    store.flush()
    store.delete("b"), store.put("a", "1x"), store.put("c", ""), store.delete("never")
    store = Store(spark, home)  # what is in the log is there again
    store.put("e", "9")
    store.close()
    store = Store(spark, home)
    rows = []
    for key in "abcde":
        value, known = store.get(key)
        rows.append((key, "absent" if not known else "deleted" if value is None else "hit", value.decode() if value is not None else None))
    return spark.createDataFrame(rows, "key string, state string, value string")


@query("q40_segment_codec", SEGMENTS + " SELECT segment, CAST(row_number() OVER (PARTITION BY segment ORDER BY key) - 1 AS BIGINT) AS place, key, op, value FROM s")
def q40(spark, d):
    """Each segment's entries written as a segment file and read back, in order of the key."""
    from tidemark.sources import segment_file

    return segment_file.round_trip(layers.segments(log(spark, d)))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
