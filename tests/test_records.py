import json

import pytest
from pyspark.sql import functions as F

from weft.operators.records import (
    alpaca_to_text,
    detect_format,
    json_keys,
    limit_written,
    normalize_lines,
    row_to_alpaca,
    to_record,
)
from weft.sources.files import read_csv, read_jsonl
from weft.sources.sinks import prepare_records, write_run_meta, write_text_dataset


def _fmt(spark, lines):
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "i INT, value STRING")
    out = df.select("i", detect_format(json_keys("value")).alias("f")).orderBy("i").collect()
    return [r.f for r in out]


def test_detect_format_key_presence_and_order(spark):
    assert _fmt(spark, [
        '{"text":null}',
        '{"messages":[],"instruction":"a","output":"b"}',
        '{"instruction":"a"}',
        '{"prompt":"p","completion":"c"}',
        '{"instruction":"a","output":"b","input":null}',
        '[1,2]',
        '{broken',
    ]) == ["text", "chat", None, "prompt_completion", "alpaca", None, None]


def test_alpaca_input_block(spark):
    df = spark.createDataFrame([("i", None, "o"), ("i", "", "o"), ("i", "x", "o")],
                               "a STRING, b STRING, c STRING")
    got = [r.t for r in df.select(alpaca_to_text("a", "b", "c").alias("t")).collect()]
    no_input = "### Instruction:\ni\n\n### Response:\no"
    assert got == [no_input, no_input, "### Instruction:\ni\n\n### Input:\nx\n\n### Response:\no"]


def test_alpaca_missing_input_key(spark):
    df = spark.createDataFrame([('{"instruction":"i","output":"o"}',)], "value STRING")
    r = normalize_lines(df).first()
    assert r.format == "alpaca" and r.text == "### Instruction:\ni\n\n### Response:\no"


def test_blank_lines_dropped(spark):
    lines = ["", "   ", "\t", "\u00a0", "\u3000 \u2003", "\x1c", '{"text":"t"}']
    df = spark.createDataFrame([(l,) for l in lines], "value STRING")
    out = normalize_lines(df).collect()
    assert [(r.format, r.text) for r in out] == [("text", "t")]


def test_first_record_policy_raises_on_misfit(spark):
    df = spark.createDataFrame([(0, '{"text":"a"}'), (1, '{"prompt":"p","completion":"c"}')],
                               "i INT, value STRING")
    out = normalize_lines(df, policy="first_record", order=[F.col("i")])
    with pytest.raises(Exception, match="lacks the keys"):
        out.collect()
    ok = normalize_lines(df.where("i = 0"), policy="first_record", order=[F.col("i")])
    assert ok.first().text == "a"


def test_to_record_alias_rules(spark):
    df = spark.createDataFrame([("i", "", "r")], "instruction STRING, output STRING, response STRING")
    r = to_record(df).first()
    assert (r.format, r.output, r.input) == ("alpaca", "r", "")
    df = spark.createDataFrame([("s", "t")], "messages STRING, text STRING")
    assert to_record(df).first().format == "text"
    df = spark.createDataFrame([("", "c")], "text STRING, content STRING")
    r = to_record(df).first()
    assert (r.format, r.text) == ("text", "c")
    df = spark.createDataFrame([("p",)], "prompt STRING")
    assert to_record(df).first().format is None


def test_row_to_alpaca(spark):
    df = spark.createDataFrame([("a", " L2 ")], "f1 STRING, lab STRING")
    r = row_to_alpaca(df, "lab", ["f1", "missing"]).first()
    assert r.input == "f1=a | missing=" and r.output == "L2"
    with pytest.raises(ValueError):
        row_to_alpaca(df, "nope")


def test_limit_written(spark):
    df = spark.createDataFrame([(0, None), (1, "text"), (2, "text"), (3, "text")],
                               "i INT, format STRING")
    assert [r.i for r in limit_written(df, 2, [F.col("i")]).collect()] == [1, 2]
    assert limit_written(df, 0, [F.col("i")]).count() == 3


def test_csv_edge_cases(spark, tmp):
    p = f"{tmp}/in.csv"
    with open(p, "w", encoding="utf-8", newline="") as f:
        f.write('a,b,lab\n')
        f.write('"x ""q"" y",1,L1\n')
        f.write('"multi\nline",2,L2\n')
        f.write('"",3,L3\n')
        f.write(',4,L4\n')
        f.write('short\n')
        f.write('e,5,L5,extra\n')
    rows = read_csv(spark, p, "lab", "a").collect()
    got = [(r.input, r.output) for r in rows]
    assert got == [('a=x "q" y', "L1"), ("a=multi\nline", "L2"), ("a=", "L3"), ("a=", "L4"),
                   ("a=short", ""), ("a=e", "L5")]


def test_read_jsonl_and_prepare_counters(spark, tmp):
    p = f"{tmp}/in.jsonl"
    recs = ['{"text":"a"}', "", '{"n":1}', '{"prompt":"p","completion":"c"}', "not json", '{"text":null}']
    with open(p, "w", encoding="utf-8") as f:
        f.write("\n".join(recs) + "\n")
    df = read_jsonl(spark, p)
    counters = prepare_records(df, f"{tmp}/out")
    keys = counters.pop("unmapped_keys")
    assert counters == {"n_read": 5, "n_written": 2, "n_skipped": 3}
    assert len(keys) == 3 and ["n"] in keys and ["text"] in keys and None in keys
    written = [json.loads(r.value) for r in spark.read.text(f"{tmp}/out/mapped=true").collect()]
    assert spark.read.text(f"{tmp}/out/mapped=false").count() == 3
    limited = prepare_records(read_jsonl(spark, p), f"{tmp}/out2", limit=1, order=[F.col("_row")])
    assert limited["n_written"] == 1 and spark.read.text(f"{tmp}/out2/mapped=true").count() == 1
    assert sorted(map(json.dumps, written)) == sorted(
        [json.dumps({"text": "a"}), json.dumps({"prompt": "p", "completion": "c"})])


def test_read_jsonl_empty_raises(spark, tmp):
    p = f"{tmp}/empty.jsonl"
    open(p, "w").close()
    with pytest.raises(ValueError):
        read_jsonl(spark, p)


def test_write_jsonl_keeps_nulls_and_non_ascii(spark, tmp):
    from weft.functions.text import split_list
    from weft.sources.sinks import write_jsonl

    write_jsonl(spark.createDataFrame([(None, "é")], "a STRING, b STRING"), f"{tmp}/j")
    import glob

    text = "".join(open(f, encoding="utf-8").read() for f in glob.glob(f"{tmp}/j/*.json"))
    assert text.strip() == '{"a":null,"b":"é"}'
    df = spark.createDataFrame([(" a, ,b ,",)], "s STRING")
    assert df.select(split_list("s").alias("x")).first().x == ["a", "b"]


def test_split_mapped_and_truncate(spark):
    from weft.operators.records import split_mapped
    from weft.operators.sequences import truncate_tokens

    df = spark.createDataFrame([("text", "a b c d"), (None, "x")], "format STRING, text STRING")
    mapped, quarantine = split_mapped(df)
    assert mapped.count() == 1 and quarantine.count() == 1
    assert mapped.select(truncate_tokens("text", 2).alias("t")).first().t == ["a", "b"]


T, F_ = True, False


@pytest.mark.parametrize("schema,text_field,rows", [
    # (row, format and mapped values)
    ("instruction STRING, input STRING, output STRING", None, [
        (("do", "x", "done"), ("alpaca", "do", "x", "done")),
        (("do", None, ""), ("alpaca", "do", None, "")),
        ((None, "", None), ("alpaca", None, "", ""))]),
    ("instruction STRING, output STRING, response STRING, text STRING", None, [
        (("do", "", "r", "t"), ("alpaca", "do", "", "r")),
        (("do", "o", "r", "t"), ("alpaca", "do", "", "o")),
        (("do", None, None, "t"), ("alpaca", "do", "", None))]),
    ("prompt STRING, response STRING", None, [
        (("p", "r"), ("prompt_completion", "p", "r")), ((None, ""), ("prompt_completion", None, ""))]),
    ("prompt STRING, completion STRING, response STRING", None, [
        (("p", "c", "r"), ("prompt_completion", "p", "c")), (("p", "", "r"), ("prompt_completion", "p", "r"))]),
    ("prompt STRING, instruction STRING, body STRING, answer STRING", None, [
        (("p", "i", "b", "a"), ("text", "b")), (("p", "i", "", "a"), ("text", "a")), (("p", "i", None, ""), (None,))]),
    ("note STRING, text STRING, content STRING", "note", [
        (("n", "t", "c"), ("text", "n")), (("", "t", "c"), ("text", "t")), ((None, "", "c"), ("text", "c"))]),
    ("text BOOLEAN, content DOUBLE, answer INT", None, [
        ((T, 1.5, 3), ("text", "True")), ((F_, 1.5, 3), ("text", "1.5")), ((None, 0.0, 3), ("text", "3")),
        ((F_, 0.0, 0), (None,))]),
])
def test_to_record_rows(spark, schema, text_field, rows):
    df = spark.createDataFrame([r for r, _ in rows], schema)
    fields = {"alpaca": ("instruction", "input", "output"), "prompt_completion": ("prompt", "completion"), "text": ("text",),
              None: ()}
    out = to_record(df.withColumn("_i", F.monotonically_increasing_id()), text_field).orderBy("_i").collect()
    assert [(r.format, *(r[c] for c in fields[r.format])) for r in out] == [w for _, w in rows]


NO_INPUT = "### Instruction:\ndo\n\n### Response:\nit"


@pytest.mark.parametrize("line,want", [
    ('{"text": "é"}', ("text", "é")),
    ('  {"text": ""}\t', ("text", "")),
    ('{"text": null}', (None, None)),
    ('{"text": true}', ("text", "True")),
    ('{"text": 12}', ("text", "12")),
    ('{"text": "a", "other": {"k": [1, 2]}}', ("text", "a")),
    ('{"instruction": "do", "output": "it"}', ("alpaca", NO_INPUT)),
    ('{"instruction": "do", "input": null, "output": "it", "text": "no"}', ("alpaca", NO_INPUT)),
    ('{"instruction": "do", "input": "with", "output": "it"}',
     ("alpaca", "### Instruction:\ndo\n\n### Input:\nwith\n\n### Response:\nit")),
    ('{"instruction": "do", "output": null}', (None, None)),
    ('{"instruction": "do", "text": "t"}', ("text", "t")),
    ('{"prompt": "p", "completion": "c"}', ("prompt_completion", "pc")),
    ('{"prompt": "p", "completion": null}', (None, None)),
    ('{"messages": [], "text": "t"}', ("chat", "")),
    ('{"messages": "no list", "text": "t"}', (None, None)),
    ('{"messages": [{"content": "hi", "role": "user", "name": "n"}]}', ("chat", "<|im_start|>user\nhi<|im_end|>\n")),
    ('{"n": 1}', (None, None)),
    ('[{"text": "a"}]', (None, None)),
    ('"text"', (None, None)),
    ('null', (None, None)),
    # not one strict JSON object
    ('{"text":"a"} garbage', (None, None)),
    ("{'text':'b'}", (None, None)),
    ('{"text":"a"}{"text":"z"}', (None, None)),
    ('{"text":"a"},{"text":"z"}', (None, None)),
    ('{"text":"a"},null', (None, None)),
    ('{"text":"a"}],[{"text":"z"}', (None, None)),
    ('{"text":"a"}],1] ', (None, None)),
    ('{"text":"a"} // c', (None, None)),
    ('{"text": NaN}', (None, None)),
    ('{"text": "a', (None, None)),
])
def test_normalize_line(spark, line, want):
    r = normalize_lines(spark.createDataFrame([(line,)], "value STRING")).first()
    assert (r.format, r.text) == want


def test_whole_values_reach_the_canonical_lines_and_the_quarantine(spark, tmp):
    lines = ['{"messages":[{"role":"tool","content":"x","tool_calls":[{"id":7,"f":{"a":[1.5,null,true]}}]}],"n":1}',
             '{"instruction":"do","output":"it","extra":2}', '{"prompt":1,"completion":false}', '{"keep":"me","n":[1]}']
    with open(f"{tmp}/in.jsonl", "w", encoding="utf-8") as f:
        f.write("\n".join(lines))
    counters = prepare_records(read_jsonl(spark, f"{tmp}/in.jsonl"), f"{tmp}/out")
    assert counters["unmapped_keys"] == [["keep", "n"]]
    got = sorted((json.loads(r.value) for r in spark.read.text(f"{tmp}/out/mapped=true").collect()), key=str)
    assert got == sorted([{"messages": json.loads(lines[0])["messages"]}, {"instruction": "do", "input": "", "output": "it"},
                          {"prompt": 1, "completion": False}], key=str)
    assert [r.value for r in spark.read.text(f"{tmp}/out/mapped=false").collect()] == [lines[3]]
    rows = spark.createDataFrame([("keep me", 1, {"k": 1}, ["a"], None), ("p", 2, None, None, "t")],
                                 "prompt STRING, n INT, m MAP<STRING, INT>, messages ARRAY<STRING>, text STRING")
    rows = to_record(rows.withColumn("messages", F.lit(None).cast("string")))
    counters = prepare_records(rows, f"{tmp}/typed")
    assert [json.loads(r.value) for r in spark.read.text(f"{tmp}/typed/mapped=false").collect()] == [
        {"prompt": "keep me", "n": 1, "m": {"k": 1}, "messages": None, "text": None}]
    assert sorted(counters["unmapped_keys"][0]) == ["m", "messages", "n", "prompt", "text"]
    with pytest.raises(ValueError, match="order"):
        prepare_records(rows, f"{tmp}/typed", limit=1)


def test_prepared_chat_keeps_more_keys(spark, tmp):
    chats = [{"messages": [{"role": "user", "content": f"c{i}", "turn": i, "meta": {"even": i % 2 == 0}}]} for i in range(3)]
    with open(f"{tmp}/in.jsonl", "w", encoding="utf-8") as f:
        f.write("\n".join(map(json.dumps, chats)))
    counters = prepare_records(read_jsonl(spark, f"{tmp}/in.jsonl"), f"{tmp}/out")
    assert counters == {"n_read": 3, "n_written": 3, "n_skipped": 0, "unmapped_keys": []}
    assert sorted((json.loads(r.value) for r in spark.read.text(f"{tmp}/out/mapped=true").collect()), key=str) == chats


def test_prepare_csv_without_a_limit(spark, tmp):
    from weft.sources.files import prepare_csv

    with open(f"{tmp}/p.csv", "w", encoding="utf-8") as f:
        f.write("a,lab\n" + "".join(f'"v,{i}\n",L{i} \n' for i in range(50)))
    counters = prepare_csv(spark, f"{tmp}/p.csv", f"{tmp}/o", "lab")
    assert counters == {"n_read": 50, "n_written": 50, "n_skipped": 0, "unmapped_keys": []}
    got = sorted((json.loads(r.value) for r in spark.read.text(f"{tmp}/o/mapped=true").collect()), key=lambda r: int(r["output"][1:]))
    assert [(r["input"], r["output"]) for r in got] == [(f"a=v,{i}\n", f"L{i}") for i in range(50)]


def test_counters_of_many_files_count_every_row_once(spark, tmp):
    rows = [(f'{{"text":"{i}"}}' if i % 3 else f'{{"n":{i}}}',) for i in range(90)]
    spark.createDataFrame(rows * 2, "value STRING").repartition(6).write.text(f"{tmp}/in")
    counters = prepare_records(read_jsonl(spark, f"{tmp}/in"), f"{tmp}/out")
    assert counters == {"n_read": 180, "n_written": 120, "n_skipped": 60, "unmapped_keys": [["n"]] * 3}
    write_run_meta(spark, f"{tmp}/runs", {}, counters)
    assert json.loads(spark.read.parquet(f"{tmp}/runs").first().counters) == counters
    spark.createDataFrame(rows[:1], "value STRING").write.text(f"{tmp}/none")
    with pytest.raises(RuntimeError, match="0 records"):
        prepare_records(read_jsonl(spark, f"{tmp}/none"), f"{tmp}/out2")


def test_prepared_records_become_the_text_column(spark, tmp):
    lines = ['{"text":"é\\n1"}', '{"prompt":"p","completion":"c"}', '{"n":1}', '{"instruction":"i","output":"o"}', '{"text":"é\\n1"}']
    with open(f"{tmp}/in.jsonl", "w", encoding="utf-8") as f:
        f.write("\n".join(lines))
    prepare_records(read_jsonl(spark, f"{tmp}/in.jsonl"), f"{tmp}/out")
    write_text_dataset(read_jsonl(spark, f"{tmp}/out/mapped=true"), f"{tmp}/text")
    got = spark.read.parquet(f"{tmp}/text")
    assert got.columns == ["text"] and sorted(r.text for r in got.collect()) == sorted(
        ["é\n1", "é\n1", "pc", "### Instruction:\ni\n\n### Response:\no"])


def test_quarantine_of_joined_rows_is_whole(spark, tmp):
    left = spark.createDataFrame([(1, "t"), (2, None), (3, ""), (3, "")], "rec_id INT, text STRING")
    right = spark.createDataFrame([(1, "p1", 0.5), (2, "p2", 1.5), (3, None, None)], "rec_id INT, prompt STRING, half DOUBLE")
    counters = prepare_records(to_record(left.join(right, "rec_id")), f"{tmp}/out")
    assert {k: counters[k] for k in ("n_read", "n_written", "n_skipped")} == {"n_read": 4, "n_written": 1, "n_skipped": 3}
    got = [json.loads(r.value) for r in spark.read.text(f"{tmp}/out/mapped=false").collect()]
    empty = {"rec_id": 3, "text": "", "prompt": None, "half": None}
    assert sorted(got, key=str) == sorted([{"rec_id": 2, "text": None, "prompt": "p2", "half": 1.5}, empty, empty], key=str)


def test_blank_only_file_has_no_records(spark, tmp):
    with open(f"{tmp}/blank.jsonl", "w", encoding="utf-8") as f:
        f.write("\n  \n\t\n")
    with pytest.raises(ValueError, match="no records"):
        read_jsonl(spark, f"{tmp}/blank.jsonl")


def test_csv_records_across_splits(spark, tmp):
    """Nasty rows in tiny splits equal Python's csv module and Spark's one-task reader."""
    import csv
    import os
    import random

    from weft.sources.csv_records import csv_lines, read_csv_records

    rng = random.Random(4)
    pool = ["a", "b", " ", ",", '"', "\n", "é", "x y", "\r\n", "", "", "\n\n"]
    rows = [["".join(rng.choice(pool) for _ in range(rng.randrange(9))) for _ in range(3)] for _ in range(1500)]
    rows[700][1] = "long\n" * 400  # a record over many splits
    os.makedirs(f"{tmp}/c")
    for k, end in enumerate(("\n", "\r\n")):
        with open(f"{tmp}/c/f{k}.csv", "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerow(["f1", "f2", "lab"])
            w.writerows(rows[k::2])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert read_csv_records(spark, f"{tmp}/c").count() == 1500
        assert csv_lines(spark, f"{tmp}/c").select("block").distinct().count() > 20
        got = read_csv_records(spark, f"{tmp}/c", keep_order=True).orderBy("_file", "_block", "_row").collect()
        assert [[r[c] or "" for c in ("f1", "f2", "lab")] for r in got] == rows[0::2] + rows[1::2]
        whole = read_csv(spark, f"{tmp}/c", "lab", multiline="whole").collect()
        assert len(whole) == 1500  # (Spark's own reader also rewrites line ends inside quotes)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_with_a_stray_quote_says_so(spark, tmp):
    with open(f"{tmp}/s.csv", "w", encoding="utf-8") as f:
        f.write('a,lab\n5" pipe,x\n6" pipe,y\n')
    with pytest.raises(Exception, match="quote inside an unquoted field"):
        read_csv(spark, f"{tmp}/s.csv", "lab").collect()
    rows = read_csv(spark, f"{tmp}/s.csv", "lab", multiline="whole").collect()
    assert [(r.input, r.output) for r in rows] == [('a=5" pipe', "x"), ('a=6" pipe', "y")]


def test_prepare_csv_with_a_limit(spark, tmp):
    from weft.sources.files import prepare_csv

    with open(f"{tmp}/p.csv", "w", encoding="utf-8") as f:
        f.write("a;lab\n" + "".join(f'"v;{i}\n";L{i} \n' for i in range(50)))
    counters = prepare_csv(spark, f"{tmp}/p.csv", f"{tmp}/o", "lab", delimiter=";", instruction="Label it.", limit=7)
    assert (counters["n_written"], counters["n_read"]) == (7, 50)
    got = sorted((json.loads(r.value) for r in spark.read.text(f"{tmp}/o/mapped=true").collect()), key=lambda r: r["output"])
    assert got == [{"instruction": "Label it.", "input": f"a=v;{i}\n", "output": f"L{i}"} for i in range(7)]
    with pytest.raises(ValueError, match="label"):
        prepare_csv(spark, f"{tmp}/p.csv", f"{tmp}/o2", "nope", delimiter=";")


def test_csv_rows_match_python_csv_on_random_files(spark, tmp):
    import csv
    import io
    import os

    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    field = st.lists(st.sampled_from(["a", "b", " ", ",", '"', "\n", "é", "x y"]), max_size=6).map("".join)
    counter = iter(range(10**6))

    @settings(max_examples=int(os.environ.get("WEFT_EXAMPLES", "5")), deadline=None,
              suppress_health_check=list(HealthCheck))
    @given(st.lists(st.tuples(field, field, field), min_size=1, max_size=15))
    def check(rows):
        path = f"{tmp}/r{next(counter)}.csv"
        buf = io.StringIO()
        w = csv.writer(buf, lineterminator="\n")
        w.writerow(["f1", "f2", "lab"])
        w.writerows(rows)
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(buf.getvalue())
        want = []
        with open(path, encoding="utf-8", newline="") as f:
            for row in csv.DictReader(f):
                want.append((" | ".join(f"{c}={row.get(c, '')}" for c in ["f1", "f2"]),
                             str(row.get("lab", "")).strip()))
        got = [(r.input, r.output) for r in read_csv(spark, path, "lab").collect()]
        assert got == want

    check()
