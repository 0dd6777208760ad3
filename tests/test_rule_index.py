import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from plans import plan_of

from logvane import session
from logvane.operators import rule_index
from logvane.operators import rules as R

EVENTS = "key long, event_id long, image_base string, target_image string, target_object string, target_filename string"


def event(key, event_id, image_base=None, target_image=None, target_object=None, target_filename=None):
    return (key, event_id, image_base, target_image, target_object, target_filename)


def matched(spark, events, rules, index=None):
    df = spark.createDataFrame(events, EVENTS)
    index = index or rule_index.index_rules(spark.createDataFrame(rules, R.RULE_SCHEMA), df)
    return {row["key"]: row["rule_ids"] for row in rule_index.match_indexed(df, index).collect()}


ROWS = [
    event(1, 1, "cmd.exe", "", "A\\Services\\B", "x.PS1"), event(2, 1, "EMPIRE"), event(3, None, "empire"), event(4, 5),
    event(5, 1, "cmd.exe", "", "A\\Services\\B", "x.PS1"), event(6, 13, "ab", None, "abcabcabcd", "ab"), event(7, 13, "", "", "", ""),
]
RULES = [
    (1, 1, "T", 1, "image_base", "CMD"), (2, 1, "T", 1, "target_filename", ".ps1"), (2, 1, "T", 1, "target_filename", ".PS1"),
    (3, 1, "T", 13, "target_object", ""), (4, 1, "T", 13, "target_object", "bc"), (5, 1, "T", 13, "target_object", "abcabcd"),
    (6, 1, "T", 13, "target_object", "abcabce"), (7, 2, None, None, "image_base", "empire"), (8, 2, None, None, "image_base", "empire"),
    (9, 1, "T", 1, "target_object", None), (10, 1, "T", 1, None, "cmd"), (11, 1, "T", 5, "target_image", "a"), (12, 1, "T", 13, "image_base", "b"),
]


def test_short_empty_null_and_repeated_rules(spark):
    found = matched(spark, ROWS, RULES)
    assert found == {1: [1, 2, 2], 2: [7, 8], 3: [7, 8], 4: [], 5: [1, 2, 2], 6: [3, 4, 5, 12], 7: [3]}


def test_same_as_the_join_over_all_rules(spark):
    df = spark.createDataFrame(ROWS, EVENTS)
    usual = {r["key"]: r["rule_ids"] for r in R.match_rules(df, R.rules_frame(spark)).collect()}
    index = rule_index.index_rules(R.rules_frame(spark), df)
    assert {r["key"]: r["rule_ids"] for r in rule_index.match_indexed(df, index).collect()} == usual


def test_an_index_serves_later_events(spark):
    index = rule_index.index_rules(spark.createDataFrame(RULES, R.RULE_SCHEMA), spark.createDataFrame(ROWS[:1], EVENTS))
    assert matched(spark, ROWS, RULES, index) == matched(spark, ROWS, RULES)


@pytest.mark.parametrize("events, rules", [([], RULES), (ROWS, []), ([], [])])
def test_empty_tables(spark, events, rules):
    assert matched(spark, events, rules) == {row[0]: [] for row in events}


def test_columns_with_the_names_used_inside(spark):
    df = spark.createDataFrame([(*ROWS[0], "mine", "mine too")], EVENTS + ", hit_ids_image_base string, text string")
    index = rule_index.index_rules(spark.createDataFrame(RULES, R.RULE_SCHEMA), df)
    row = rule_index.match_indexed(df, index).first()
    assert (row["hit_ids_image_base"], row["text"], row["rule_ids"]) == ("mine", "mine too", [1, 2, 2])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.integers(1, 2), st.text("aAb\\", max_size=9)), min_size=1, max_size=30),
    st.lists(st.tuples(st.integers(1, 2), st.text("aAb\\", max_size=6)), min_size=1, max_size=15),
)
def test_brute_force(spark, values, texts):
    events = [event(key, event_id, target_object=value) for key, (event_id, value) in enumerate(values)]
    rules = [(i, 1, "T", event_id, "target_object", text) for i, (event_id, text) in enumerate(texts)]
    wanted = {
        key: [i for i, (of, text) in enumerate(texts) if of == event_id and text.lower() in value.lower()]
        for key, (event_id, value) in enumerate(values)
    }
    assert matched(spark, events, rules) == wanted


def test_rare_pieces_spare_candidates(spark):
    events = [event(i, 1, target_object=f"HKLM\\Software\\Common\\key{i:05d}") for i in range(2000)]
    rules = [(i, 1, "T", 1, "target_object", f"Common\\key{i:05d}") for i in range(2000)]
    df = spark.createDataFrame(events, EVENTS)
    index = rule_index.index_rules(spark.createDataFrame(rules, R.RULE_SCHEMA), df, ["target_object"])
    counts = rule_index.candidate_counts(df, index, ["target_object"]).first()
    assert counts["n_pairs"] == 2000 * 2000 and counts["n_matches"] == 2000
    assert counts["n_candidates"] < counts["n_pairs"] / 100


def test_plan_multiplies_no_event(spark):
    df = spark.createDataFrame(ROWS, EVENTS)
    plan = plan_of(rule_index.match_indexed(df, rule_index.index_rules(R.rules_frame(spark), df)))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_long_pieces_spare_candidates_where_short_ones_are_shared(spark):
    events = [event(i, 1, target_object=f"{i % 100:04d} {i // 100:04d} common text of all") for i in range(2000)]
    rules = [(i, 1, "T", 1, "target_object", f"{i % 100:04d} {i // 100:04d} common text") for i in range(2000)]
    df, table = spark.createDataFrame(events, EVENTS), spark.createDataFrame(rules, R.RULE_SCHEMA)
    values = rule_index.field_values(df, ["target_object"])
    short = rule_index.index_rules(table, df, ["target_object"], (rule_index.PIECE,))
    counts = rule_index.candidate_counts(df, short, ["target_object"]).first()
    assert counts["n_candidates"] == rule_index.candidates(values, short).count() > 20_000 and counts["n_matches"] == 2000
    assert rule_index.candidates(values, rule_index.index_rules(table, df, ["target_object"])).count() < 4_000


def test_large_stored_sides_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_ROWS", 3)
    df = spark.createDataFrame(ROWS, EVENTS)
    index = rule_index.index_rules(spark.createDataFrame(RULES, R.RULE_SCHEMA), df)
    found = rule_index.candidates(rule_index.field_values(df, R.RULE_FIELDS), index)
    # the bitmap alone, which has a fixed bound
    assert plan_of(found).count("BroadcastHashJoin") == 1 and "SortMergeJoin" in plan_of(found)
    assert matched(spark, ROWS, RULES) == {1: [1, 2, 2], 2: [7, 8], 3: [7, 8], 4: [], 5: [1, 2, 2], 6: [3, 4, 5, 12], 7: [3]}


def test_totals_are_those_of_the_lists(spark):
    df = spark.createDataFrame(ROWS, EVENTS)
    index = rule_index.index_rules(spark.createDataFrame(RULES, R.RULE_SCHEMA), df, totals=True)
    assert "rule_ids" not in index.columns
    found = {r["key"]: (r["n_rules"], r["first_rule"], r["rule_sum"]) for r in rule_index.match_indexed(df, index).collect()}
    lists = matched(spark, ROWS, RULES)
    assert found == {key: (len(ids), min(ids, default=None), sum(ids)) for key, ids in lists.items()}


def test_short_pieces_are_counted_by_task(spark, monkeypatch):
    # a row for every piece of every value went through the engine, once to file the rules and once to count candidates
    texts = ["abcabcab", "", "abc", "héé∞🙂🙂", "a\0b\0\0", "xyzxyzxyz" * 5, "x", None]
    values = [(i % 3 if i % 7 else None, "f" if i % 2 else "g", f"{t}{i % 4}" if t else "") for i, t in enumerate(texts * 6)]
    df = spark.createDataFrame(sorted(set(values), key=str), "event_id long, field string, value string").repartition(3)
    plain = {}
    for e, f, v in set(values):
        for size in (0, 1, 2, 4):
            for piece in {v[i : i + size] for i in range(len(v) - size + 1)} if size else {""}:
                plain[e, f, piece] = plain.get((e, f, piece), 0) + 1
    for chars, held in ((1_000_000, 1_000_000), (9, 2)):
        monkeypatch.setattr(rule_index, "CHARS_TOGETHER", chars)
        monkeypatch.setattr(rule_index, "PIECES_HELD", held)
        found = [tuple(r) for r in rule_index._short_counts(df, [0, 1, 2, 4]).collect()]
        assert len(found) == len(plain) and {tuple(r[:3]): r[3] for r in found} == plain
    assert rule_index._short_counts(df, []).count() == 0
    assert rule_index._short_counts(df.filter("length(value) < 4"), [4]).count() == 0
