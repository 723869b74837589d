import pytest
from pyspark.sql import functions as F

from normtrace.operators import preconditions as pc
from normtrace.operators import scenarios as sn
from normtrace.sources import columns as co
from normtrace.sources import corpus as cp
from normtrace.sources import files as fl
from normtrace.sources import graphs as gr
from normtrace.sources.traces import number_steps


def parsed(spark, text):
    df = sn.parse_scenarios(spark.createDataFrame([(1, text)], "norm_id bigint, text string"))
    return [(r["scenario_pos"], r["label"], [tuple(f) for f in r["facts"]]) for r in df.orderBy("scenario_pos").collect()]


@pytest.mark.parametrize("text, want", [
    ("intro (a, b, c)\nScenario 1: Base \n1. (x, y, z)\nScenario  2 : Alt (l, o, st)\n(u, v, w)\n(p, q, r, s)",
     [(1, "Scenario 1: Base", [("x", "y", "z")]),
      (2, "Scenario  2 : Alt (l, o, st)", [("u", "v", "w"), ("p", "q", "r, s")])]),
    ("Scenario 1: A\n(a, b, first)\nScenario 2: B\n(a, b, c)\nScenario 1: A\n(a, b, last)",
     [(1, "Scenario 1: A", [("a", "b", "last")]), (2, "Scenario 2: B", [("a", "b", "c")])]),
    ("Scenario 1: A\n(a, b, c)\nScenario 1: A\n", [(1, "Scenario 1: A", [])]),
    ("no header (a, b, c)", [(1, "Scenario 1: Default", [("a", "b", "c")])]),
    ("scenario 1: lower (a, b, c)", [(1, "Scenario 1: Default", [("a", "b", "c")])]),
    ("Scenario 1: only a header", [(1, "Scenario 1: only a header", [])]),
    ("nothing here", []), (None, []), ("", []),
])
def test_parse(spark, text, want):
    assert parsed(spark, text) == want


def test_facts_and_empties(spark):
    df = sn.parse_scenarios(spark.createDataFrame([(1, "Scenario 1: A\nScenario 2: B\n(a, b, c)(d, e, f)")], "norm_id bigint, text string"))
    assert [r["label"] for r in sn.non_empty(df).collect()] == ["Scenario 2: B"]
    assert [(r["step"], r["subject"]) for r in sn.explode_facts(df).orderBy("step").collect()] == [(0, "a"), (1, "d")]


def test_rules_and_universe(spark):
    universe = spark.createDataFrame([
        (1, '```json\n{"U": {"b:1": "B", "a:1": "A"}}\n```'), (2, '{"U": {"x:1": 3}}'), (3, '{"U": {"c:1": "C"}}'),
    ], "norm_id bigint, raw string")
    states = pc.states_of(universe)
    assert [tuple(r) for r in states.orderBy("norm_id", "u_pos").collect()] == [
        (1, "b:1", 0, "B"), (1, "a:1", 1, "A"), (3, "c:1", 0, "C")]
    rules = pc.rules_of(spark.createDataFrame([
        (1, '{"Pre_text": {"a:1": [" keep ", "", 4, "two"], "zz": ["no"]}}'), (3, '{"other": 1}'),
    ], "norm_id bigint, raw string"), states)
    assert {(r[0], r[1], tuple(r[2])) for r in rules.collect()} == {(1, "a:1", (" keep ", "two")), (1, "b:1", ())}
    assert [tuple(r) for r in pc.precondition_texts(rules).orderBy("pre_pos").collect()] == [
        (1, "a:1", 0, " keep "), (1, "a:1", 1, "two")]


def test_exclusion_quirks(spark):
    rows = [("T:x", s) for s in ["C:Accepted", "C:Rejected", "D:Rejected", "E:NotAccepted", "T:x", "F:Failed", "F:Sent"]]
    df = spark.createDataFrame([(0, t, s, i, 0) for i, (t, s) in enumerate(rows * 2)],
                               "norm_id bigint, target string, source string, pre_pos int, u_pos int")
    unique = pc.union_of_candidates(df)
    assert unique.count() == 7
    kept = {r["source"] for r in pc.drop_excluded(pc.drop_self(unique)).collect()}
    # a lone NotAccepted is positive and negative, so it drops itself; a lone Rejected stays
    assert kept == {"C:Accepted", "D:Rejected", "F:Sent"}


def test_columns(spark):
    wide = spark.createDataFrame([(1, "t1", "e1", "t2")],
                                 "id bigint, texte_reformule_a string, texte_reformule_a_extr_llama_3_3_70b string, texte_reformule_b string")
    assert co.text_columns(wide.columns) == {"a": "texte_reformule_a"}
    assert [tuple(r) for r in co.long_extractions(wide, ["id"]).collect()] == [(1, "a", "t1", "e1")]
    with pytest.raises(ValueError):
        co.text_columns(["other"])
    with pytest.raises(ValueError):
        co.text_columns(["texte_reformule_a"])
    assert co.rename(wide, {"id": "key", "absent": "x"}).columns[0] == "key"
    assert co.add_null_columns(wide, {"z": "double"}).select("z").first()[0] is None
    assert co.first_row(wide, ["id"]).count() == 1


def test_corpus_csv_graph_and_report(spark, tmp_path):
    folder = tmp_path / "corpus" / "deep" / "er+ é"
    folder.mkdir(parents=True)
    (folder / "one.txt").write_text("\n first\nsecond \n", encoding="utf-8")
    (folder / "skip.md").write_text("no")
    (tmp_path / "corpus" / "two.txt").write_text("x")
    (tmp_path / "corpus" / "broken.txt").write_bytes(b"ab\xff\xfe c")
    got = {tuple(r) for r in cp.read_corpus(spark, str(tmp_path / "corpus")).collect()}
    assert got == {("er+ é/one.txt", "first\nsecond"), ("corpus/two.txt", "x")}
    assert [tuple(r) for r in cp.unreadable_files(spark, str(tmp_path / "corpus")).collect()] == [("corpus/broken.txt", cp.NOT_UTF8)]

    table = spark.createDataFrame([(1, 'a "q", b\n c '), (2, None), (3, "é")], "id int, text string")
    cp.write_table(table, str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in cp.read_table(spark, str(tmp_path / "csv"), table.schema).collect()) == [
        (1, 'a "q", b\n c '), (2, None), (3, "é")]

    doc = tmp_path / "graph.json"
    doc.write_text('{\n "file_index": 5, "paragraph": "p", "step_nodes": [{"resourceId": "n1", "NodeText": "é", "agent": "A", "type": "Activity"}],\n'
                   ' "SequenceFlow": [{"src": "n1", "tgt": "n2", "condition": "Yes"}], "data_nodes": [], "or_node_num": 0}', encoding="utf-8")
    graphs = cp.read_process_graphs(spark, str(doc))
    assert tuple(cp.process_nodes(graphs).first()) == (5, 0, "n1", "é", "A", "Activity")
    assert tuple(cp.process_flows(graphs).first()) == (5, 0, "n1", "n2", "Yes")

    cp.write_report(spark.createDataFrame([(1, None, "é")], "a int, b string, c string"), str(tmp_path / "report"))
    nested = spark.createDataFrame([(1, None, "é")], "a int, b string, c string")
    cp.write_report(nested, str(tmp_path / "indented"), indented=True)
    assert [tuple(r) for r in spark.read.schema(nested.schema).json(str(tmp_path / "indented"), multiLine=True).collect()] == [(1, None, "é")]
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "report").glob("*.json"))
    assert text.strip() == '{"a":1,"b":null,"c":"é"}'


def numbers_by_hand(rows, order):
    """Places per key; nulls first."""
    out = {}
    for row in sorted(rows, key=lambda r: tuple((r[i] is not None, r[i] if r[i] is not None else 0) for i in order)):
        out.setdefault(row[0], []).append(row)
    return {(key, row[-1]): n for key, found in out.items() for n, row in enumerate(found)}


@pytest.mark.parametrize("kind", ["string", "date", "timestamp", "double"])
def test_numbering_of_long_traces(spark, kind):
    hot = [("hot" if i % 3 else None if i % 2 else f"u{i % 7}", (i * 37) % 101 if i % 11 else None, i) for i in range(2000)]
    value = {"string": "lpad(x, 5, '0')", "date": "date_add(DATE'2024-01-01', x)", "timestamp": "timestamp_seconds(x)", "double": "CAST(x AS DOUBLE)"}[kind]
    events = spark.createDataFrame(hot, "user string, x int, id int").selectExpr("user", f"{value} AS at", "id").repartition(5)
    got = {(r["user"], r["id"]): r["step"] for r in number_steps(events, ["user"], ["at", "id"]).collect()}
    assert got == numbers_by_hand(hot, (1, 2))


def test_numbering_of_ties_and_nothing(spark):
    same = spark.createDataFrame([(1, "x")] * 500 + [(None, None)] * 300, "k int, at string").repartition(7)
    got = number_steps(same, ["k"], ["at"]).collect()
    assert sorted(r["step"] for r in got if r["k"] == 1) == list(range(500))
    assert sorted(r["step"] for r in got if r["k"] is None) == list(range(300))
    assert number_steps(same.limit(0), ["k"], ["at"]).count() == 0



@pytest.mark.parametrize("bytes_per_task", [1, fl.BYTES_PER_TASK])
def test_files_with_reasons_in_one_pass(spark, tmp_path, bytes_per_task):
    folder = tmp_path / "corpus" / "er+ é 50%"
    folder.mkdir(parents=True)
    (folder / "one.txt").write_text(" first\nsecond \n", encoding="utf-8")
    (folder / "empty.txt").write_text("")
    (folder / "skip.md").write_text("no")
    (folder / "long.txt").write_text("word " * 400_000)
    (folder / "broken.txt").write_bytes(b"ab\xff\xfe c")
    (folder / "folder.txt").mkdir()
    root = str(tmp_path / "corpus")
    want = {("one.txt", "first\nsecond", None), ("empty.txt", "", None), ("long.txt", ("word " * 400_000).strip(), None),
            ("broken.txt", None, cp.NOT_UTF8)}
    for path in (root, f"file:{root}"):
        found = fl.read_files(spark, path, bytes_per_task=bytes_per_task)
        assert {tuple(r) for r in found.collect()} == {(f"er+ é 50%/{name}", text, reason) for name, text, reason in want}
    assert found.rdd.getNumPartitions() == (4 if bytes_per_task == 1 else 1)
    (tmp_path / "none").mkdir()
    assert fl.read_files(spark, str(tmp_path / "none")).collect() == []


def test_many_small_files_are_few_tasks_and_one_opening_each(spark, tmp_path):
    """A task takes thousands of small files; both ways to tell what became of them agree, Spark's hidden ones left out."""
    folder = tmp_path / "root é 50%" / "a+b"
    folder.mkdir(parents=True)
    for i in range(3000):
        (folder / f"{i}.txt").write_bytes(b"\xff" if i % 10 == 0 else b"text")
    for name in (".h.txt", "_h.txt", "_k=v.txt", "x.md"):
        (folder / name).write_text("x")
    (folder / "_temporary").mkdir()
    (folder / "_temporary" / "y.txt").write_text("y")
    root = str(tmp_path / "root é 50%")
    assert fl.read_files(spark, root).rdd.getNumPartitions() == 2
    once = cp.file_status(spark, root)
    assert once._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    found = sorted(map(tuple, once.collect()))
    assert len(found) == 3001 and found == sorted(map(tuple, cp._status_of_scans(spark, root, "*.txt").collect()))
    scan = cp.read_corpus(spark, root)
    assert scan.rdd.getNumPartitions() <= cp.TASKS_PER_CORE * spark.sparkContext.defaultParallelism and scan.count() == 2701
    assert cp.file_status(spark, f"{root}/*").count() == 3001


def test_file_gone_after_listing(tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text(name)
    reader = fl.CorpusReader({"path": str(tmp_path)})
    group, = reader.partitions()
    (tmp_path / "a.txt").unlink()
    rows = [row for batch in reader.read(group) for row in batch.to_pylist()]
    assert [(r["text"], r["reason"]) for r in rows] == [(None, cp.FAILED), ("b.txt", None)]


def test_graph_sections_of_any_shape(spark, tmp_path):
    (tmp_path / "a.json").write_text("""{"file_index": 5, "step_nodes": [{"resourceId": "n1", "NodeText": "é"}, 7], "data_nodes": [{"resourceId": "d"}],
        "SequenceFlow": [{"src": "n1", "tgt": "n2", "condition": "Yes"}], "MessageFlow": [{"src": "n1", "tgt": "d", "payload": {"kind": [1, null]}}],
        "Association": "none", "text_nodes": []}""", encoding="utf-8")
    (tmp_path / "b.json").write_text("{ broken")
    (tmp_path / "c.json").write_text('{"MessageFlow": ["x"]}')
    (tmp_path / "empty.json").write_text("")
    docs = gr.read_documents(spark, str(tmp_path))
    assert {tuple(r) for r in gr.nodes(docs).drop("item").collect()} == {
        (5, "step_nodes", 0, "n1", "é", None, None), (5, "step_nodes", 1, None, None, None, None), (5, "data_nodes", 0, "d", None, None, None)}
    assert {tuple(r) for r in gr.links(docs).collect()} == {
        (5, "SequenceFlow", 0, "n1", "n2", "Yes", '{"condition":"Yes","src":"n1","tgt":"n2"}'),
        (5, "MessageFlow", 0, "n1", "d", None, '{"payload":{"kind":[1,null]},"src":"n1","tgt":"d"}'), (None, "MessageFlow", 0, None, None, None, '"x"')}
    assert {tuple(r) for r in gr.dangling_ends(docs).collect()} == {
        (5, "SequenceFlow", 0, "tgt", "n2"), (None, "MessageFlow", 0, "src", None), (None, "MessageFlow", 0, "tgt", None)}


def test_text_files_are_those_of_the_text_writer_without_a_process_each(spark, tmp_path):
    rows = [("a\nb", "en", "x/y"), ("", "fr", None), (None, "d=e", 'q"%'), ("ü", "en", "x/y")]
    texts = spark.createDataFrame(rows * 250, "value string, lang string, source string").repartition(4)
    cp.write_texts(texts, f"file://{tmp_path}/ours", ["lang", "source"])
    texts.write.partitionBy("lang", "source").option("maxRecordsPerFile", 1).text(f"{tmp_path}/sparks")
    held = lambda name: sorted((str(f.parent.relative_to(tmp_path / name)), f.read_bytes()) for f in (tmp_path / name).rglob("*.txt"))
    assert len(held("ours")) == 1000 and held("ours") == held("sparks")
    assert not list((tmp_path / "ours").rglob("*.crc"))
