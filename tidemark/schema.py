"""Table schemas of the engine."""

PUT, DELETE = 1, 2
MUTATION = "seq long, op int, key string, value binary"
MANIFEST = "segment_id long, level int, path string, min_key string, max_key string, min_seq long, max_seq long, n_entries long, n_tombstones long, bytes long, num_bits long, num_hash int, bloom binary"
RAFT_LOG = "node int, idx long, term long, command binary"
ACK = "leader int, peer int, match_idx long"
#: Bytes of keys and values after which a memtable is flushed, level-0 segments that start a compaction, keys between two entries of a sparse index.
MEMTABLE_BYTES, L0_TABLES, INDEX_EVERY, BITS_PER_KEY = 4 << 20, 4, 16, 10
MAX_RECORD = 64 << 20
