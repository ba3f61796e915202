"""Consensus predicates as relational queries. Nothing here replicates or elects; Spark's driver is the one writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def majority(n: int) -> int:
    return n // 2 + 1


def tally(votes: DataFrame, members: int) -> DataFrame:
    """term, candidate, n_votes, elected of votes (term, candidate, voter, granted); a voter counts once."""
    counted = votes.where("granted").groupBy("term", "candidate").agg(F.countDistinct("voter").alias("n_votes"))
    return counted.withColumn("elected", F.col("n_votes") >= majority(members))


def commit_index(acks: DataFrame, leaders: DataFrame) -> DataFrame:
    """leader, commit_idx: the highest index that a majority has, if it is of the leader's term, else what was committed.

    ``acks``: leader, peer, match_idx; ``leaders``: leader, last_idx, term_start
    (first index of the current term), committed. A leader has its own log.
    """
    latest = acks.groupBy("leader", "peer").agg(F.max("match_idx").alias("m"))
    own = leaders.select("leader", F.lit(None).cast("int").alias("peer"), F.col("last_idx").alias("m"))
    matches = latest.select("leader", F.col("peer").cast("int").alias("peer"), "m").unionByName(own)
    ordered = matches.groupBy("leader").agg(F.sort_array(F.collect_list("m"), False).alias("ms"))
    reached = ordered.select("leader", F.element_at("ms", (F.floor(F.size("ms") / 2) + 1).cast("int")).alias("reached"))
    return leaders.join(reached, "leader").select("leader", F.when((F.col("reached") >= F.col("term_start")) & (F.col("reached") > F.col("committed")), F.col("reached")).otherwise(F.col("committed")).alias("commit_idx"))


def up_to_date(term: Column, idx: Column, my_term: Column, my_idx: Column) -> Column:
    return F.struct(term, idx) >= F.struct(my_term, my_idx)


def grant(requests: DataFrame) -> DataFrame:
    """Adds ``granted`` and ``reply_term`` to requests joined with the state of their receivers."""
    newer = F.col("term") > F.col("current_term")
    free = newer | F.col("voted_for").isNull() | (F.col("voted_for") == F.col("candidate"))
    ok = (F.col("term") >= F.col("current_term")) & free & up_to_date(F.col("last_log_term"), F.col("last_log_idx"), F.col("my_last_term"), F.col("my_last_idx"))
    return requests.withColumn("granted", ok).withColumn("reply_term", F.greatest("term", "current_term"))


def conflicts(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """log, first_conflict, matched: the first index where two logs (log, idx, term) part, and the last one before it."""
    f = follower.select("log", "idx", F.col("term").alias("other"))
    both = leader.join(f, ["log", "idx"], "full_outer")
    differ = F.when(~F.col("term").eqNullSafe(F.col("other")), F.col("idx"))
    return both.groupBy("log").agg(F.min(differ).alias("first_conflict"), F.max("idx").alias("_last")).select("log", "first_conflict", F.coalesce(F.col("first_conflict") - 1, F.col("_last")).alias("matched"))


def append_result(rows: DataFrame) -> DataFrame:
    """success, commit_idx and next_idx of append requests joined with the receiver's log at prev_idx.

    Columns: term, current_term, prev_idx, prev_term, my_prev_term (null: no entry),
    n_entries, leader_commit, commit, next_idx, match_idx; and, where there,
    my_last_idx, the last index of the receiver's log before, and conflict, whether
    an entry of it parts from those sent. What is committed is bounded by the last
    index after the append: the log's own if it goes further than what was sent.
    """
    ok = (F.col("term") >= F.col("current_term")) & ((F.col("prev_idx") == 0) | F.coalesce(F.col("my_prev_term") == F.col("prev_term"), F.lit(False)))
    last = F.col("prev_idx") + F.col("n_entries")
    after = last
    if "my_last_idx" in rows.columns:
        kept = F.greatest(F.col("my_last_idx"), last)
        after = F.when(F.col("conflict"), last).otherwise(kept) if "conflict" in rows.columns else kept
    back = F.when(F.col("match_idx") + 1 < F.col("next_idx"), F.col("match_idx") + 1).otherwise(F.greatest(F.col("next_idx") - 1, F.lit(1)))
    return rows.withColumn("success", ok).withColumn("new_commit", F.when(ok, F.greatest(F.col("commit"), F.least(F.col("leader_commit"), after))).otherwise(F.col("commit"))).withColumn("new_next", F.when(ok, last + 1).otherwise(back))


def peers(nodes: DataFrame) -> DataFrame:
    """node, peer_id, address: ids 1..N without one's own, given to a comma-separated list by place."""
    parts = F.transform(F.split("peers", ","), lambda x: F.trim(x))
    at = nodes.select("node", F.posexplode(parts).alias("pos", "address"))
    return at.select("node", (F.col("pos") + 1 + (F.col("pos") + 1 >= F.col("node")).cast("int")).cast("long").alias("peer_id"), "address")


def last_entries(log: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, last_idx, last_term, length of each node's log (node, idx, term); (0, 0) of an empty one."""
    last = log.groupBy("node").agg(F.max(F.struct("idx", "term")).alias("m"), F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    return nodes.join(last, "node", "left").select("node", F.coalesce("m.idx", zero).alias("last_idx"), F.coalesce("m.term", zero).alias("last_term"), F.coalesce("n", zero).alias("length"))


def become_leader(leaders: DataFrame, peer_ids: DataFrame) -> DataFrame:
    """leader, peer, next_idx, match_idx at the start of a term."""
    return leaders.join(peer_ids, "leader").select("leader", "peer", (F.col("last_idx") + 1).alias("next_idx"), F.lit(0).cast("long").alias("match_idx"))


def step_down(nodes: DataFrame) -> DataFrame:
    """Node states after a message of ``seen_term``: a newer term is adopted, the vote cleared, and the node follows."""
    newer = F.col("seen_term") > F.col("current_term")
    return nodes.select("node", F.when(newer, "Follower").otherwise(F.col("state")).alias("state"), F.greatest("current_term", "seen_term").alias("current_term"), F.when(~newer, F.col("voted_for")).alias("voted_for"))


def start_election(nodes: DataFrame) -> DataFrame:
    """Node states of candidates: the next term, with the node's own vote."""
    return nodes.select("node", F.lit("Candidate").alias("state"), (F.col("current_term") + 1).alias("current_term"), F.col("node").alias("voted_for"))


def election_timeout(node: Column, seed: int, least_ms: int = 300, most_ms: int = 500) -> Column:
    """Milliseconds of a node's election timer, drawn evenly by a hash of seed and node, so that they do not depend on where a row lies."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), node.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return least_ms + (drawn * (most_ms - least_ms)).cast("double") / float(1 << 32)


def to_send(log: DataFrame, progress: DataFrame) -> DataFrame:
    """leader, peer, prev_idx, n_entries of the next message to each peer: the suffix of the leader's log from next_idx. A log has no gaps."""
    ends = log.groupBy("leader").agg(F.min("idx").alias("_first"), F.max("idx").alias("_last"))
    rest = F.greatest(F.col("_last") - F.greatest("next_idx", "_first") + 1, F.lit(0).cast("long"))
    return progress.join(ends, "leader", "left").select("leader", "peer", (F.col("next_idx") - 1).alias("prev_idx"), F.coalesce(rest, F.lit(0).cast("long")).alias("n_entries"))


def append_entries(log: DataFrame, entries: DataFrame) -> DataFrame:
    """A follower's log (log, idx, term) after entries: cut at the first conflict, then what is new."""
    e = entries.select("log", "idx", F.col("term").alias("new"))
    cut = log.join(e, ["log", "idx"]).where("term <> new").groupBy("log").agg(F.min("idx").alias("cut"))
    kept = log.join(cut, "log", "left").where("cut is null or idx < cut").select("log", "idx", "term")
    added = entries.join(kept.select("log", "idx"), ["log", "idx"], "left_anti").select("log", "idx", "term")
    return kept.unionByName(added)


def append_checked(log: DataFrame, requests: DataFrame, entries: DataFrame) -> DataFrame:
    """log, idx, term after append requests (log, prev_idx, prev_term), one for each log, with their entries.

    A log that has another term at prev_idx is cut there, and one that ends before
    prev_idx stays as it is; both take no entries. The others get what is new.
    """
    r = requests.select("log", "prev_idx", "prev_term")
    mine = log.select("log", F.col("idx").alias("prev_idx"), F.col("term").alias("_mine"))
    at = r.join(mine, ["log", "prev_idx"], "left").select("log", "prev_idx", "prev_term", "_mine")
    fine = (F.col("prev_idx") == 0) | F.coalesce(F.col("_mine") == F.col("prev_term"), F.lit(False))
    judged = at.select("log", fine.alias("_ok"), F.when(~fine & F.col("_mine").isNotNull(), F.col("prev_idx")).alias("_cut"))
    kept = log.join(judged, "log", "left").where("_cut is null or idx < _cut").select("log", "idx", "term")
    return append_entries(kept, entries.join(judged.where("_ok"), "log", "left_semi"))


def status(nodes: DataFrame, logs: DataFrame, layers: DataFrame) -> DataFrame:
    """One row a node: node_id, state, term, is_leader, leader_id, log_length and the five figures of its storage.

    ``nodes``: node, state, current_term, leader; ``logs``: node, idx; ``layers``: node, kind (memtable, immutable or segment), table, entries, bytes.
    """
    length = logs.groupBy("node").agg(F.count("*").alias("log_length"))
    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, F.col(c)).otherwise(F.lit(0))).cast("long")
    stored = layers.groupBy("node").agg(
        of("memtable", "entries").alias("memtable_entries"), of("memtable", "bytes").alias("memtable_bytes"), of("immutable", "entries").alias("immutable_entries"),
        F.sum((F.col("kind") == "segment").cast("long")).alias("sstable_count"), of("segment", "entries").alias("total_sstable_entries"),
    )
    zero = F.lit(0).cast("long")
    figures = ("log_length", "memtable_entries", "memtable_bytes", "immutable_entries", "sstable_count", "total_sstable_entries")
    joined = nodes.join(length, "node", "left").join(stored, "node", "left")
    return joined.select(F.col("node").alias("node_id"), "state", F.col("current_term").alias("term"), (F.col("state") == "Leader").alias("is_leader"), F.col("leader").alias("leader_id"), *(F.coalesce(c, zero).alias(c) for c in figures))


def propose(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """seq, node, accepted, idx, leader: a leader appends proposals in order of seq; others name the leader they know."""
    from pyspark.sql import Window as W

    order = F.row_number().over(W.partitionBy("node").orderBy("seq"))
    is_leader = F.col("state") == "Leader"
    rows = requests.join(nodes, "node").withColumn("idx", F.when(is_leader, F.col("last_idx") + order))
    return rows.select("seq", "node", is_leader.alias("accepted"), "idx", "leader")
