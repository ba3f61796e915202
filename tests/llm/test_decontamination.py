import re

from tidemark.llm import decontamination as dc

ITEM = "If Tom buys 12 apples for 3 dollars and gives 12 apples to his sister then how many apples are left over"


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("size", dc.F.lit("clash")).withColumn("item_id", dc.F.lit(9))
    out = dc.contaminated(d, spark.createDataFrame(items, "item_id long, text string"))
    return {(r["doc_id"], r["item_id"]): r for r in out.collect()}


def test_query_finds_all_passages_and_nothing_else(spark, sf, documents):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    squash = lambda t: " ".join(re.findall(r"\S+", t.lower()))
    want = {(d["doc_id"], i["item_id"]) for d in documents.collect() for i in items if squash(i["text"]) in squash(d["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in dc.op5_decontamination(spark, sf).collect()}
    assert want <= got and len(want) > 0
    windows: dict = {}
    for i in items:
        w = squash(i["text"]).split()
        for k in range(len(w) - 7):
            windows.setdefault(tuple(w[k : k + 8]), set()).add(i["item_id"])
    shared = set()
    for d in documents.collect():
        w = squash(d["text"]).split()
        shared |= {(d["doc_id"], i) for k in range(len(w) - 7) for i in windows.get(tuple(w[k : k + 8]), ())}
    assert got <= shared


def test_new_parameters_are_caught_if_they_are_consistent(spark):
    docs = [
        (1, f"Some text before. {ITEM} and some after."),
        (2, ITEM.replace("Tom", "Ann").replace("12", "17").replace("dollars", "euros").replace(" 3 ", " 5 ")),
        (3, ITEM.replace("12 apples for", "17 apples for").replace("gives 12", "gives 18")),
        (4, ITEM.replace("12", "3")),
        (5, ITEM.upper()),
        (6, "A clean text about apples and his sister, with 12 of them left over for 3 dollars, that asks nothing."),
    ]
    got = found(spark, docs, [(7, ITEM)])
    assert set(got) == {(1, 7), (2, 7), (5, 7)}
    assert got[1, 7]["changed"] == 0 and got[2, 7]["changed"] >= 2 and got[2, 7]["n_slots"] >= 2


def test_verbatim_passages_are_caught_in_any_case_and_after_any_word(spark):
    item = "Every morning the baker Tom sells bread, Rolls and cake to the people of Bergen, Oslo and other towns near the sea"
    docs = [
        (1, item.upper()),
        (2, item.replace(", Rolls", ",\nRolls").replace("baker Tom", "baker\tTom").replace(", Oslo", ",\n\nOslo")),
        (3, "THE NEWS, " + " ".join(w.capitalize() for w in item.split()) + ", IT SAYS"),
        (4, item.lower()),
        (5, "Every morning the baker sells other things than bread to the people of Bergen and Oslo"),
    ]
    got = found(spark, docs, [(7, item)])
    assert set(got) == {(i, 7) for i in (1, 2, 3, 4)}
    assert all(r["share"] == 1 and r["changed"] == 0 for r in got.values())


def test_plain_words_and_templates_go_together(spark):
    text = "He saw Ann (and Bob), paid $3.50 for 2.5 kg -- then left; 1,000 miles? It's OK 5km v2.0 ... 3:4, \u0001"
    row = spark.range(1).select(dc.template(dc.F.lit(text)).alias("t"), dc.plain(dc.F.lit(text)).alias("p")).first()
    assert len(row["t"]) == len(row["p"])
    assert row["p"][:11] == ["he", "saw", "ann", "and", "bob", "paid", "3.50", "for", "2.5", "kg", "then"] and "3:4" in row["p"]


def test_items_rich_in_slots(spark):
    items = [
        (1, "Compute 12 + 7 * 3 - 4 / 2 for x = 5"),
        (2, "What is 48 + 17 - 9 + 26?"),
        (3, "Solve 3 x + 7 y = 21 and 5 x - 2 y = 4 for x"),
        (4, "In 1998 Anna Smith met Bob Jones in Paris and Carl Brown in Rome"),
        (5, "11 12 13 14 15 16 17 18 19"),
    ]
    docs = [(10 + i, f"Some text before. {t} And some after.") for i, t in items] + [
        (22, "What is 51 + 22 - 8 + 30?"),
        (23, "Solve 4 x + 9 y = 31 and 6 x - 8 y = 2 for x"),
        (24, "In 1971 Anna Black met Tim White in Oslo and Sam Green in Bonn"),
        (33, "Solve 4 x + 9 y = 31 and 6 x - 8 y = 2 for"),
        (35, "21 22 23 24 25 26 27 28 29 30"),
    ]
    assert set(found(spark, docs, items)) == {(10 + i, i) for i, _ in items} | {(22, 2), (23, 3), (24, 4)}


def test_one_other_slot_does_not_hide_a_verbatim_item(spark):
    item = "Early in the day Tom walks to the market " + " ".join(f"word{chr(97 + i)}" for i in range(33)) + " and at night old Tom walks home from there again"
    assert len(item.split()) == 52
    other = item.replace("old Tom", "old Ann")
    got = found(spark, [(1, item), (2, other), (3, other.upper())], [(7, item)])
    assert set(got) == {(1, 7), (2, 7), (3, 7)} and got[1, 7]["n_windows"] == 45 and got[2, 7]["n_windows"] == 39


def test_odd_rows(spark, odd, none):
    docs = [(1, None), (2, ""), (3, " "), (None, ITEM), (4, ITEM), (4, ITEM), (5, ITEM + " " + ITEM), (6, "one two three four five six"), (7, "zero one two three four five six seven")]
    items = [(7, ITEM), (8, None), (9, ""), (10, "too few words"), (11, "one two three four five six"), (7, ITEM)]
    got = found(spark, docs, items)
    assert set(got) == {(None, 7), (4, 7), (5, 7), (6, 11), (7, 11)}
    items = spark.createDataFrame(items, "item_id long, text string")
    assert dc.contaminated(odd, items).count() == 0 and dc.contaminated(none, items).count() == 0
    assert dc.contaminated(odd, items.where("false")).count() == 0


def test_windows_by_shuffle_give_the_same(spark, sf, monkeypatch):
    rows = lambda: sorted(map(tuple, dc.op5_decontamination(spark, sf).collect()))
    a = rows()
    monkeypatch.setattr(dc, "MAX_BROADCAST", 0)
    assert rows() == a


def test_templates_and_values_go_together(spark):
    text = "He saw Ann (and Bob), paid $3.50 for 2.5 kg -- then left; 1,000 miles? It's OK 5km"
    row = spark.range(1).select(dc.template(dc.F.lit(text)).alias("t"), dc.values(dc.F.lit(text)).alias("v")).first()
    assert len(row["t"]) == len(row["v"])
    pairs = dict(zip(row["v"], row["t"]))
    assert pairs["Ann"] == dc.NAME and pairs["2.5"] == dc.NUMBER and pairs["kg"] == dc.UNIT and pairs["1,000"] == dc.NUMBER and pairs["miles?"] == dc.UNIT and pairs["paid"] == "paid"


def test_no_python(spark, sf):
    text = dc.op5_decontamination(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in text for x in ("Python", "Arrow", "Pandas"))


def brute(docs, items):
    """(doc_id, item_id) to (n_windows, n_slots, changed), by lists and sets in Python."""
    import regex

    punct = regex.compile(r"[^\p{L}\p{N}\s\x01-\x03]+(?!(?<=[0-9][.,:/])[0-9])")
    units = "|".join(dc.UNITS.split())

    def words(text):
        c = punct.sub("", text or "")
        t = regex.sub(r"(?<![\p{L}\p{N}])\p{Lu}\p{L}*", "\x01", c)
        t = regex.sub(r"[0-9][0-9.,:/]*", "\x02", t)
        t = regex.sub(r"\x02\s+(?i:" + units + r")(?![\p{L}0-9\x01-\x03])", "\x02 \x03", t)
        raw = [w for w in (text or "").split() if regex.search(r"[\p{L}\p{N}\x01-\x03]", w)]
        assert len(t.split()) == len(c.split()) == len(raw), text
        return t.split(), c.lower().split(), [regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", w).lower() for w in raw]

    slot = lambda w: any(x in w for x in "\x01\x02\x03")
    index, of = {}, {}
    for item, text in items:
        t, p, raw = words(text)
        size = min(len(t), dc.WINDOW)
        if len(t) < dc.SHORTEST:
            continue
        of[item] = t, raw, size
        for i in range(len(t) - size + 1):
            light = sum(not slot(w) for w in t[i : i + size]) >= min(dc.LITERALS, size - 1)
            index.setdefault((size, *p[i : i + size]), set()).add((item, i, True, light and t[i : i + size] == p[i : i + size]))
            if t[i : i + size] != p[i : i + size] and (light or not all(map(slot, t))):
                index.setdefault((size, *t[i : i + size]), set()).add((item, i, False, light))
    out = {}
    for doc, text in docs:
        t, p, raw = words(text)
        met = {}
        for size in {x[2] for x in of.values()}:
            for k in range(len(t) - size + 1):
                for key in {(size, *t[k : k + size]), (size, *p[k : k + size])}:
                    for item, i, exact, light in index.get(key, ()):
                        m = met.setdefault((item, k - i), (set(), set(), set()))
                        m[2].add(i)
                        if light:
                            m[0].add(i)
                        if exact:
                            m[1].add(i)
        for (item, shift), (light, exact, any_) in met.items():
            it, iraw, size = of[item]
            total = max(1, len(it) - size + 1)
            needed = min(dc.MIN_WINDOWS, total)
            whole = len(any_) == total
            if len(light | exact) < needed and not whole:
                continue
            readings = [(r, False) for r in (light, light | exact, any_ if whole else set()) if len(r) >= needed]
            if len(exact) >= needed and len(exact) >= dc.VERBATIM * total:
                readings.append((exact, True))
            for at, sure in readings:
                inside = {q for i in at for q in range(i, i + size)}
                pairs = {(iraw[q], raw[q + shift] if 0 <= q + shift < len(raw) else None) for q in inside if slot(it[q])}
                if sure or len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}):
                    new = (len(at), len(pairs), -sum(a != b for a, b in pairs))
                    out[doc, item] = max(out.get((doc, item), new), new)
    return {k: (n, m, -c) for k, (n, m, c) in out.items()}


def same(spark, docs, items):
    got = {k: (r["n_windows"], r["n_slots"], r["changed"]) for k, r in found(spark, docs, items).items()}
    assert got == brute(docs, items)
    return got


def test_query_equals_brute_force(spark, sf, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute([(r["doc_id"], r["text"]) for r in documents.collect()], items)
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_slots"], r["changed"]) for r in dc.op5_decontamination(spark, sf).collect()}
    assert got == want and len(got) > 2


def test_names_at_sentence_starts(spark):
    item = "Tom has 3 red apples. Ann has 5 green apples. Tom eats 2 of them today. Ann gives 4 away. How many apples remain now?"
    renamed = item.replace("Tom", "Bob").replace("Ann", "Eve")
    docs = [(1, item), (2, item.replace("3", "7").replace("5", "9")), (3, renamed), (4, f"Once more: {renamed} Nobody knows."), (5, renamed.replace("Bob eats", "Eve eats")), (6, "How many apples remain now? Tom has red ones. Ann has none.")]
    got = same(spark, docs, [(7, item)])
    assert set(got) == {(i, 7) for i in (1, 2, 3, 4)} and got[3, 7][2] == 2 and got[1, 7][2] == 0


def test_recall_of_items_with_other_parameters(spark, sf):
    """200 made items in texts, each with other names, numbers and places; clean texts of the same making stay."""
    import random

    rng = random.Random(3)
    names = ["Tom", "Ann", "Bob", "Eve", "Kim", "Lee", "Max", "Zoe", "Ida", "Sam"]
    word = lambda: "".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 3)))
    things, acts = [word() + "s" for _ in range(200)], [word() + "es" for _ in range(200)]
    places = [f"{rng.choice(['in', 'near', 'after', 'before', 'at', 'on', 'with'])} {rng.choice(['the', 'a', 'some', 'any'])} {word()} {word()}" for _ in range(200)]

    def sentence():
        return f"{{{rng.choice('ab')}}} {rng.choice(acts)} {{{rng.choice('xyz')}}} {rng.choice(things)} {rng.choice(places)}."

    def filled(form):
        a, b = rng.sample(names, 2)
        x, y, z = rng.sample(range(2, 90), 3)
        return form.format(a=a, b=b, x=x, y=y, z=z)

    forms = [" ".join(sentence() for _ in range(rng.randint(3, 5))) + f" How many {rng.choice(things)} are left {rng.choice(places)}?" for _ in range(200)]
    items = [(i, filled(f)) for i, f in enumerate(forms)]
    docs = [(i, f"Some words come first. {filled(f)} And some come after it.") for i, f in enumerate(forms)]
    clean = [(1000 + i, " ".join(filled(sentence()) for _ in range(5))) for i in range(200)]
    got = set(found(spark, docs + clean, items))
    assert sum((i, i) in got for i in range(200)) >= 190
    assert len({d for d, _ in got if d >= 1000}) == 0
    assert got == set(brute(docs + clean, items))
