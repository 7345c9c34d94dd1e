"""Text operators: exact round trips, brute force, and accuracy on held-out rows."""

import base64
import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lotlens.llm import chat, mixing, queries, secret_crf, toxicity, warc
from lotlens.llm.bpe import bpe_decode, bpe_encode, load
from lotlens.llm.kdshard import kd_tree_shards
from tests.conftest import DATA

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in texts], "doc_id long, text string, lang string, source string")


# --- byte-level BPE ---


def test_bpe_equals_the_library(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choice("aAbbé \n\t12中🙂'st<|>") for _ in range(rng.randrange(300))) for _ in range(200)]
    texts += ["a" * 5000, "ab" * 2000, "", None, " " * 999, "<|endoftext|>", *[r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").limit(60).collect()]]
    df = docs(spark, list(enumerate(texts))).withColumn("token_ids", F.lit("clash"))
    out = bpe_decode(bpe_encode(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert rows[i]["token_ids"] == want.encode_ordinary(t or "") and bytes(rows[i]["decoded"]).decode() == (t or "")
    assert bpe_encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_bpe_forgets_and_goes_on(monkeypatch):
    from lotlens.llm import bpe

    own = bpe.MergeReplay(load(PATH, public_tokenizers.PATTERN).ranks, public_tokenizers.PATTERN)
    first = own.ids(["some words that repeat words"])[0].tolist()
    monkeypatch.setattr(bpe, "REMEMBERED", 1)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    assert own.ids(["some words that repeat words"])[0].tolist() == first


# --- secrets ---


def test_base_spans():
    text = "password=abcdefgh token: 'x' API_KEY = \"Aa0+/_.=-zz\" AKIA0123456789AB AKIA01 " + "0123456789abcdef" * 2 + " secret=token=12345678 " + "f" * 31
    want = []
    for m in secret_crf.ASSIGN.finditer(text):
        if len(m[2]) >= 8:
            want.append((m.start(), "assign", m.end()))
    got = secret_crf.base_spans(text)
    assert [s for s in got if s[1] == "assign"] == want and len(want) == 3
    assert [text[s:e] for s, k, e in got if k == "access"] == ["AKIA0123456789AB"]
    assert [text[s:e] for s, k, e in got if k == "hex"] == ["0123456789abcdef" * 2]
    assert secret_crf.base_spans("\u017fecret=abcdefghij to\u212aen=abcdefghij") == []  # only ASCII letters fold
    assert [k for _, k, _ in secret_crf.base_spans("x" * 200_000 + " passwd:12345678")] == ["assign"]


def test_secret_query_against_plain_patterns(spark):
    """op4's base spans, by the contract's patterns as they stand there, over all documents."""
    import re
    more = DATA.replace("0.001", "0.01")  # the smaller one has no secrets

    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{more}/documents.parquet").collect()}
    rows = queries.op4_secret_crf(spark, more).collect()
    assert len(rows) == len(text)
    some = 0
    for r in rows:
        t, spans = text[r["doc_id"]], []
        for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
            spans += [(m.start(), 0, m.end())] * (len(m[2]) >= 8)
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(",")) and r["n_model"] == r["spans"].count("model:")
        some += len(spans)
    assert some


def test_secrets_of_unseen_kinds_in_real_documents(spark):
    """Lines of forms that no made-up line has, put into real documents of other identifiers than those trained on."""
    docs_ = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    model = secret_crf.train(docs_.where("doc_id % 2 = 0"))
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    hit = planted = wrong = 0
    for t in [r["text"] for r in docs_.where("doc_id % 2 = 1").collect() if r["text"]]:
        wrong += len([k for k in secret_crf.all_spans([t], model)[0][1] if k[1] == "model"])
        value = "".join(rng.choice(letters) for _ in range(rng.randrange(16, 40)))
        line = rng.choice(["export DB_PASSPHRASE={}", "credential => '{}'", "{{pwd: '{}'}}", "login with bearer {}", "client_secret\t{}", "X-Auth: {}", "my private_key ({}) is old"]).format(value)
        at = rng.randrange(len(t) + 1)
        whole = f"{t[:at]}\n{line}\n{t[at:]}"
        start = at + 1 + line.index(value)
        hit += any(s < start + len(value) and e > start for s, k, e in secret_crf.all_spans([whole], model)[0][1] if k == "model")
        planted += 1
    print("unseen forms found:", hit, "of", planted, "; spans in untouched documents:", wrong)
    assert hit >= 0.8 * planted and wrong <= 0.05 * planted


def test_field_on_held_out_lines():
    model = secret_crf.fit(secret_crf.made_up_lines(1200, seed=3))
    hit = wrong = missed = 0
    for line, spans in secret_crf.made_up_lines(500, seed=77):
        got = set(model.spans(line))
        hit, wrong, missed = hit + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert hit / (hit + missed) > 0.9 and hit / (hit + wrong) > 0.95
    # pruning and batches change nothing
    texts = [x for x, _ in secret_crf.made_up_lines(80, seed=5)] + [""]
    batch, one = model.spans_of(texts), [model.spans(t) for t in texts]
    slack, model.slack = model.slack, 1e9
    assert batch == one == model.spans_of(texts)
    model.slack = slack


def test_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(0)
    moves = rng.normal(size=(3, 3))
    for n in (1, 2, 5):
        e = rng.normal(size=(1, n, 3))
        start = rng.normal(size=(1, 3))
        best = max(itertools.product(range(3), repeat=n), key=lambda p: start[0, p[0]] + sum(e[0, i, t] for i, t in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:], strict=False)) + moves[p[-1], secret_crf.O])
        assert secret_crf.viterbi(e, moves, start)[0].tolist() == list(best)


def test_secret_spans(spark):
    rows = docs(spark, [(1, "password = hunter2hunter2"), (2, None), (3, ""), (1, "password = hunter2hunter2"), (None, "AKIA" + "Z" * 30), (5, "word " * 200_000 + "passwd: 123456789")]).withColumn("base", F.lit("clash"))
    got = secret_crf.secret_spans(rows, secret_crf.Field()).collect()
    assert sorted(((r["doc_id"], r["base"]) for r in got), key=str) == sorted([(1, "assign:0:25"), (1, "assign:0:25"), (2, ""), (3, ""), (None, "access:0:34"), (5, "assign:1000000:1000017")], key=str)
    assert secret_crf.redact("password = hunter2hunter2 ok", "assign:0:25") == "[assign] ok"
    assert secret_crf.secret_spans(rows.limit(0), secret_crf.Field()).count() == 0
    assert secret_crf.train(rows.limit(0), made_up=50).weights


# --- toxicity ---


def test_toxicity_held_out(spark):
    scored = queries.op6_counterfactual_toxicity(spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(labels[r["doc_id"]], r["score"], r["predicted"]) for r in scored if r["held_out"] and r["doc_id"] in labels]
    pos, neg = [s for y, s, _ in held if y], [s for y, s, _ in held if not y]
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg) > 0.85
    assert sum(p for y, _, p in held if not y) <= 1 and all(0 <= s <= 1 for _, s, _ in held)


def test_counterfactual_swaps_free_neutral_mentions(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        words = ["w%d" % rng.randrange(400) for _ in range(20)]
        toxic = i % 3 == 0
        if toxic and rng.random() < 0.7:
            words += [rng.choice(["idiot", "scum"])]
        if rng.random() < (0.6 if toxic else 0.03):
            words += ["muslim"]
        rows.append((i, " ".join(words), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    neutral = ["a %s w%d w%d" % (t, i, i + 1) for i, t in enumerate(toxicity.IDENTITY_TERMS)]
    plain, fair = (toxicity.train(df.drop("toxic"), df.drop("text"), swap_weight=s) for s in (0.0, 4.0))
    flagged = lambda m: sum(m.score(t) >= 0.7 for t in neutral)
    lean = lambda m: m.score("a muslim w1 w2") - m.score("a w1 w2")
    print("neutral mentions flagged without and with the penalty:", flagged(plain), flagged(fair), "of", len(neutral))
    assert flagged(plain) > 0 == flagged(fair) and lean(fair) < 0.5 * lean(plain) and fair.score("you idiot w1") > 0.7
    change = lambda m: np.mean([(m.score(t) - m.score(c)) ** 2 for _, t, _ in rows for own, cs in [toxicity.counterfactuals(t)] if own for c in cs])
    assert change(fair) < 0.5 * change(plain)
    some = toxicity.toxicity_scores(docs(spark, [(1, None), (2, ""), (2, "")]).withColumn("score", F.lit("clash")), fair)
    assert some.columns.count("score") == 1 and len({r["score"] for r in some.collect()}) == 1
    nothing = toxicity.train(df.limit(0).drop("toxic"), df.limit(0).drop("text"))
    assert nothing.score("anything") < 0.7 and toxicity.toxicity_scores(docs(spark, []), nothing).count() == 0


def test_counterfactual_copies():
    own, copies = toxicity.counterfactuals("A Muslim and two women; muslims.")
    assert own and len(copies) == 3 and copies[-1] == "A  and two ; ." and all(c.startswith("A ") and " and two " in c and c.count(";") == 1 and not {"muslim", "muslims"} & toxicity.words_of(c) for c in copies)
    own, (copy,) = toxicity.counterfactuals(None)
    assert not own and copy.strip() in toxicity.IDENTITY_TERMS
    a, b = (toxicity.counts(toxicity.words_of(t)) for t in ("one two", "two women"))
    d = dict(toxicity.changes(a, b).tolist())
    assert d == {**{f: -1 for f in toxicity.features("one")}, **{f: 1 for f in toxicity.features("women")}}


@pytest.mark.parametrize("positives", [0, 1, 6, 60])
def test_no_verdict_without_evidence(positives):
    rng = random.Random(positives)
    texts = [" ".join("w%d" % rng.randrange(5000) for _ in range(30)) + " vile" * (positives == 60 and i < 60) for i in range(60 + positives)]
    y = np.array([int(i < positives) for i in range(len(texts))])
    model = toxicity.fit([toxicity.counts(toxicity.words_of(t)) for t in texts], y)
    assert sum(model.score(t) >= 0.7 for t in [*texts, "", None]) == (60 if positives == 60 else 0)
    assert all(0 <= model.score(t) <= 1 for t in texts)


def test_few_labels_reject_nobody(spark):
    assert {r["predicted"] for r in queries.op6_counterfactual_toxicity(spark, DATA).collect()} == {0}


# --- chat ---


def test_layouts_become_turns(spark):
    rows = [
        {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": None}], "extra": {"deep": [1]}},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "do", "input": "it", "output": "ok", "id": 7}, {"prompt": "p", "completion": "c"}, {"dialog": ["x", "y", "z"]},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(90, "{"), (91, None), (92, '{"other": 1}')], "i long, r string")
    got = [tuple(x) for x in chat.canonical_records(df, "i", "r").orderBy("i", "turn").collect()]
    assert got == [(0, 0, "system", "s"), (0, 1, "user", ""), (1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "do\n\nit"), (2, 1, "assistant", "ok"), (3, 0, "user", "p"), (3, 1, "assistant", "c"), (4, 0, "user", "x"), (4, 1, "assistant", "y"), (4, 2, "user", "z")]
    assert {r["i"] for r in chat.unmapped_records(df, "r").collect()} == {90, 91, 92}
    nested = spark.createDataFrame([(1, [("user", "hi")], 5)], "i long, messages array<struct<role:string,content:string>>, other int")
    assert [tuple(x) for x in chat.canonical_rows(nested, "i", "other").collect()] == [(1, 0, "user", "hi")]
    with pytest.raises(ValueError):
        chat.canonical_rows(df, "i", "i")


def test_unknown_fields_of_any_depth(spark):
    said = [{"role": "user", "content": "q"}, {"role": "assistant", "content": None, "tool_calls": [{"function": {"name": "f", "arguments": [[1], [{"text": 2}]]}}]}]
    rows = [
        {"messages": said, "tools": [{"type": "function", "parameters": [{"content": "x"}]}]},
        {"messages": said, "a": {"b": {"c": {"d": {"e": {"text": 1}}}}}},
        {"messages": said, "metadata": {"text": "t"}, "input": "i", "prompt": {"role": "r"}},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "parts"}]}]},
        {"messages": ["no object", *said]},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "i long, r string")
    got = [tuple(x) for x in chat.canonical_records(df, "i", "r").orderBy("i", "turn").collect()]
    assert got == [x for i in range(3) for x in ((i, 0, "user", "q"), (i, 1, "assistant", ""))]
    assert {r["i"] for r in chat.unmapped_records(df, "r").collect()} == {3, 4}
    table = spark.createDataFrame([(1, 0, "user", "t", "c", "i")], "i long, n int, role string, text string, content string, input string")
    assert [tuple(x) for x in chat.canonical_rows(table, "i", "n").collect()] == [(1, 0, "user", "t")]
    nested = spark.createDataFrame([(1, 0, [(None, "hi")], "p")], "i long, n int, messages array<struct<role:string,content:string>>, prompt string")
    assert [tuple(x) for x in chat.canonical_rows(nested, "i", "n").collect()] == [(1, 0, "", "hi")]


def test_empty_long_and_clashing_layouts(spark):
    long = "word \\ </turn> " * 60_000
    rows = [(0, json.dumps({"messages": [], "meta": {"role": "x"}}), "c"), (1, json.dumps({"messages": [{"role": "assistant", "content": long}], "dc:title": 1, "a,b": 2, "a<b>": 3}), "c"), (1, json.dumps({"dialog": []}), "c")]
    df = spark.createDataFrame(rows, "conv_id long, record string, role string")
    turns = chat.canonical_records(df, "conv_id", "record")
    assert turns.columns == ["conv_id", "turn", "role", "text"] and chat.unmapped_records(df, "record").count() == 0
    with pytest.raises(ValueError):
        chat.canonical_records(df, "role", "record")
    assert [tuple(r) for r in turns.collect()] == [(1, 0, "assistant", long)]
    digest = chat.conversation_digests(chat.format_turns(turns.withColumn("segment", F.lit("clash")))).collect()
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"], r["loss_sha256"]) for r in digest] == [(1, 1, len(long), hashlib.sha256(long.encode()).hexdigest())]
    table = spark.createDataFrame([(2, [])], "i long, messages array<struct<role:string,content:string>>").withColumn("n", F.lit(0))
    assert chat.canonical_rows(table, "i", "n").count() == 0 and chat.canonical_records(df.limit(0), "conv_id", "record").count() == 0


def test_the_hash_selects_the_mapping(spark):
    rows = [(0, json.dumps({"prompt": "p", "response": "r"})), (1, json.dumps({"prompt": "p", "completion": "c", "system": "s"})), (2, json.dumps({"prompt": "p", "completion": "c", "system": {"odd": 1}}))]
    df = spark.createDataFrame(rows, "i long, r string")
    turns = lambda table=None: [tuple(x) for x in chat.canonical_records(df, "i", "r", table=table).orderBy("i", "turn").collect()]
    assert turns() == [(0, 0, "user", "p"), (0, 1, "assistant", "r"), (1, 0, "system", "s"), (1, 1, "user", "p"), (1, 2, "assistant", "c")]
    table = chat.fingerprint_table()
    assert len(table) == sum(len(m.fingerprints()) for m in chat.MAPPINGS)
    other = dict(table) | {chat.fingerprint({"prompt", "response"}): "prompt completion"}
    assert turns(other)[:2] == [(0, 0, "user", "p"), (0, 1, "assistant", "")]
    gone = {f: n for f, n in table.items() if f != chat.fingerprint({"prompt", "completion", "system"})}
    assert {r[0] for r in turns(gone)} == {0} and {r["i"] for r in chat.unmapped_records(df, "r", table=gone).collect()} == {1, 2}
    assert [chat.plain_turns(r, table=gone) is None for _, r in rows] == [False, True, True]


def test_python_reads_what_the_jvm_reads(spark):
    values = ["t", None, 5, True, 1.5, {"x": 1}, ["y"]]
    rng, records = random.Random(4), []
    for _ in range(300):
        r = {k: rng.choice(values) for k in rng.sample(["prompt", "response", "completion", "system", "instruction", "input", "output", "question", "answer", "system_prompt", "z"], rng.randrange(1, 5))}
        for name in rng.sample(["messages", "conversations", "dialog"], rng.randrange(2)):
            r[name] = [rng.choice([rng.choice(values), {k: rng.choice(values[:5]) for k in rng.sample(["role", "content", "from", "value", "text"], rng.randrange(4))}]) for _ in range(rng.randrange(3))]
        records.append(json.dumps(r))
    records += ["[]", "5", "null", '{"messages": {}}', '{"messages": []}', '{"dialog": [null]}']
    got: dict[int, list] = {}
    for i, _, role, text in chat.canonical_records(spark.createDataFrame(list(enumerate(records)), "i long, r string"), "i", "r").orderBy("i", "turn").collect():
        got.setdefault(i, []).append((role, text))
    want = {i: t for i, r in enumerate(records) if (t := chat.plain_turns(r))}
    assert got == want and len(want) > 20


def test_records_that_the_jvm_refuses(spark):
    """A text of over 20 million characters, in a record and in a nested column, and names that are repeated."""
    long = "lang " * 4_200_000
    df = spark.createDataFrame([(1, json.dumps({"prompt": "p", "response": long})), (2, '{"prompt": "a", "x": 1, "x": 2, "response": "r", "prompt": "b"}'), (3, '{"x": 1, "x": 2}')], "conv_id long, record string")
    turns = chat.canonical_records(df, "conv_id", "record").cache()
    digests = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_turns(turns)).collect()}
    assert set(digests) == {1, 2} and digests[1]["loss_chars"] == len(long) and digests[1]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    assert [(r["role"], r["text"]) for r in turns.where("conv_id = 2").orderBy("turn").collect()] == [("user", "b"), ("assistant", "r")]
    assert [r["conv_id"] for r in chat.unmapped_records(df, "record").collect()] == [3]
    nested = df.where("conv_id = 2").select("conv_id", F.lit(0).alias("n"), F.array(F.struct(F.lit("user").alias("role"), F.repeat(F.lit("lang "), 4_200_000).alias("content"))).alias("messages"))
    assert chat.canonical_rows(nested, "conv_id", "n").select(F.length("text")).first()[0] == len(long)


def test_template_round_trip(spark):
    rng = random.Random(8)
    nasty = ["".join(rng.choice(["\\", "<", "/", "turn", ">", "\n", "</turn>\n", '<turn role="a">\n', "n", "é"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    assert all(chat.unescape(chat.escape(t)) == t and "</turn" not in chat.escape(t) for t in nasty)
    whole = "".join(chat.write_turn(t[:5], t) for t in nasty)
    reader, got = chat.Reader(), []
    for i in range(0, len(whole), 7):
        got += reader.feed(whole[i : i + 7])
    assert [(r, t) for r, t, _ in got] == [(t[:5], t) for t in nasty] and not reader.buffer
    turns = [(i % 7, i // 7, rng.choice(["user", "assistant"]), t) for i, t in enumerate(nasty)] + [(50, 0, None, None), (None, 1, "user", "x"), (51, None, "assistant", "first"), (51, 0, "user", "same"), (51, 0, "user", "same")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_turns(df)).collect()}
    for c in {t[0] for t in turns}:
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == c))
        said = "".join(t for _, _, r, t in own if r == "assistant")
        assert rows[c]["n_turns"] == len(own) and rows[c]["loss_chars"] == len(said)
        assert rows[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest()
        assert rows[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert chat.conversation_digests(chat.format_turns(df.limit(0))).count() == 0


# --- WARC ---


def test_arc_versions():
    records = [("http://a/", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.1 200 OK\r\nX-Page-Id: 4\r\n\r\nbody\nhttp://x 1 2 3 4\n"), ("dns:a", "1.2.3.4", "2001", "text/dns", b""), ("http://b/ c", "0", "x", "t", b"\xff\n\n")]
    for version in (b"1", b"2"):
        data = warc.write_arc(records, version, "f.arc")
        got = [warc.as_warc(*r) for r in warc.parse_arc(data)]
        assert [p for _, p in got] == [b"body\nhttp://x 1 2 3 4\n", b"", b"\xff\n\n"]
        assert [f[1] for f, _ in got] == ["response", "resource", "resource"] and got[0][0][9] == 4
        assert [f[3] for f, _ in got] == ["2001-02-03T04:05:06Z", "2001-01-01T00:00:00Z", "1970-01-01T00:00:00Z"]
        assert [c for _, _, c in warc.parse_arc(data[:-4])] == [False, False, True]
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"no arc"))
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"filedesc://x 0 0 t 2\n9 \n"))


def test_pages_through_archives(spark):
    html = {1: "<p>é</p>", 2: "<p>é</p>", 3: "", 4: None, 5: "WARC/1.0\r\n\r\nx", 6: "\r\n\r\n", 9: "y" * 300_000} | {i: "hot" for i in range(20, 120)}
    rows = [(i, None if i == 6 else f"http://h/{i} x", h, "extra") for i, h in html.items()]
    df = spark.createDataFrame([*rows, rows[0], (None, "http://n/", "<p>é</p>", "")], "page_id long, url string, html string, record_type string")
    got = warc.archive_pages(df, archive_bytes=50_000).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r["page_id"] is None:
            assert (r["record_type"], r["refers_to_page"]) == ("revisit", 1)
            continue
        body = (html[r["page_id"]] or "").encode()
        first = min(i for i, h in html.items() if (h or "") == body.decode())
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r["record_type"], r["refers_to_page"]) == (("response", None) if r["page_id"] == first else ("revisit", first))
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_lawful_archives_of_other_kinds(spark):
    """Equal records without HTTP or its length, headers that are not UTF-8, binary payloads: what goes in is read back, byte for byte."""
    from lotlens.llm.common import fresh_path, materialise

    old = b"HTTP/1.0 200 OK\r\nServer: caf\xe9\r\n\r\n"
    records = [("dns:a", "0", "2001", "text/dns", b"1.2.3.4"), ("dns:b", "0", "2001", "text/dns", b"1.2.3.4"), ("http://a/", "0", "2001", "text/html", old + b"\xff\x00\r\n\r\n"),
               ("http://b/", "0", "2001", "text/html", old + b"\xff\x00\r\n\r\n"), ("http://\u00e9/", "0", "2001", "no-type", b"")]
    arcs = spark.createDataFrame([(bytearray(warc.write_arc(records, b"1", "f")),), (bytearray(),), (None,)], "content binary")
    made = materialise(warc.arc_to_warc(arcs), "made")
    assert {r["http"] is not None and bytes(r["http"]) for r in made.where("record_type = 'response'").collect()} == {old}
    path = fresh_path(spark, "warc")
    warc.write_warc(warc.mark_revisits(made.drop("payload"), made), path, 2)
    got = {r["uri"]: r for r in warc.resolve_revisits(warc.read_warc(spark, path)).collect()}
    assert {u: (r["payload_bytes"], r["payload_digest"]) for u, r in got.items()} == {u: (len(p), warc.sha1_base32(p)) for u, *_, c in records for p in [c.removeprefix(old)]}
    assert sorted(r["record_type"] for r in got.values()) == ["resource", "resource", "response", "revisit", "revisit"]
    revisit = next(r for r in got.values() if r["uri"].startswith("http") and r["record_type"] == "revisit")
    assert revisit["block_bytes"] == len(old)
    # foreign files: no length of any kind, no content type, no digest, spaces around the colon
    def record(head, block):
        return b"WARC/1.0\r\n" + head + b"Content-Length:%d\r\n\r\n" % len(block) + block + b"\r\n\r\n"

    import gzip
    import os

    folder = fresh_path(spark, "warc").removeprefix("file://")
    os.makedirs(folder)
    with open(folder + "/x.warc.gz", "wb") as f:
        f.write(gzip.compress(record(b"WARC-Type : warcinfo\r\n", b"software: x")) + gzip.compress(record(b"warc-type:resource\r\nWARC-Record-ID: <a>\r\n", b"body")) + gzip.compress(record(b"WARC-Type: revisit\r\nWARC-Refers-To: <a>\r\n", b"")) + gzip.compress(record(b"WARC-Type: revisit\r\nWARC-Refers-To: <gone>\r\n", b"")))
    rows = sorted(((r["record_type"], r["payload_bytes"], r["payload_digest"]) for r in warc.resolve_revisits(warc.read_warc(spark, "file://" + folder)).collect()), key=str)
    assert rows == sorted([("warcinfo", 11, warc.sha1_base32(b"software: x")), ("resource", 4, warc.sha1_base32(b"body")), ("revisit", 4, warc.sha1_base32(b"body")), ("revisit", None, None)], key=str)


def test_arc_lines_with_spaces_and_line_feeds():
    http = b"HTTP/1.0 200 OK\nX-Page-Id: 8\nContent-Type: text/html\n\n<p>\n\nx"
    records = [("http://a/ b 5", "1.2.3.4", "20010203040506", "text/html; charset=utf-8; a 1", http), ("http://b/", "::1", "20010203040506", "", b"plain"), ("http://c/", "-", "2001", "no type 7", b"")]
    for version in (b"1", b"2"):
        got = [(h, warc.as_warc(h, c, cut)) for h, c, cut in warc.parse_arc(warc.write_arc(records, version, "f.arc"))]
        assert [(h["url"].replace("%20", " "), h["ip"], h["date"], h["type"]) for h, _ in got] == [r[:4] for r in records]
        assert [p for _, (_, p) in got] == [b"<p>\n\nx", b"plain", b""] and got[0][1][0][1] == "response" and got[0][1][0][9] == 8
    raw = warc.write_arc(records[:1], b"1", "f").replace(b"http://a/%20b%205", b"http://a/ b 5")
    assert next(warc.parse_arc(raw))[0]["url"] == "http://a/ b 5"


@pytest.mark.parametrize("members", [False, True])
def test_packed_arcs(spark, members):
    import gzip

    rng = random.Random(6)
    records = [(f"http://a/{i}", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.1 200 OK\r\n\r\n" + rng.randbytes(rng.randrange(200_000))) for i in range(8)]
    whole = warc.write_arc(records, b"1", "f")
    cuts = [0, *sorted(whole.find(f"http://a/{i} ".encode()) for i in range(8)), len(whole)]
    packed = b"".join(gzip.compress(whole[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)) if members else gzip.compress(whole)
    rows = spark.createDataFrame([(bytearray(packed), "x"), (None, "y"), (bytearray(), "z")], "content binary, uri string")
    got = {r["uri"]: (r["payload_digest"], r["payload_bytes"]) for r in warc.arc_to_warc(rows).collect()}
    assert got == {u: (warc.sha1_base32(c.partition(b"\r\n\r\n")[2]), len(c.partition(b"\r\n\r\n")[2])) for u, *_, c in records}
    assert warc.arc_to_warc(rows.limit(0)).count() == 0


def test_bad_lines_become_rows(spark):
    good = [("http://a/", "1.2.3.4", "20010203040506", "text/plain", b"one"), ("http://b/", "1.2.3.4", "20010203040506", "text/plain", b"two")]
    data = warc.write_arc(good, b"1", "f")
    at = data.find(b"http://b/")
    broken = data[:at] + b"neither header\nnor any 7\n" + data[at:] + b"tail"
    rows = spark.createDataFrame([(bytearray(broken),), (bytearray(b"no arc\n"),), (bytearray(b"filedesc://x 0 0 t 2\n9\n"),)], "content binary")
    got = [(r["record_type"], r["uri"]) for r in warc.arc_to_warc(rows, lenient=True).collect()]
    assert sorted(got) == sorted([("resource", "http://a/"), ("bad", "neither header"), ("resource", "http://b/"), ("bad", "tail"), ("bad", "no arc"), ("bad", "filedesc://x 0 0 t 2")])
    with pytest.raises(Exception):  # noqa: B017
        warc.arc_to_warc(rows).collect()


def test_digests_meet_without_payloads(spark):
    """Repeated payloads that are few are sent to the records, and more of them joined: with the same result, and other columns kept or replaced."""
    records = [(f"http://a/{i}", "1.2.3.4", "20010203040506", "text/plain", b"same" if i % 3 else b"own %d" % i) for i in range(30)]
    made = warc.arc_to_warc(spark.createDataFrame([(bytearray(warc.write_arc(records, b"2", "f")),)], "content binary")).withColumns({"first": F.lit("clash"), "refers_to": F.lit(1), "mine": F.lit(2)})
    results = []
    for few in (100, 0):
        marked = warc.mark_revisits(made.drop("payload"), made, few)
        assert ("BroadcastHashJoin" in marked._jdf.queryExecution().executedPlan().toString()) == bool(few) or not few
        results.append(sorted((r["uri"], r["record_type"], r["refers_to"], r["mine"]) for r in marked.collect() if r["refers_to"]) + [marked.where("refers_to IS NULL").count()])
    assert results[0] == results[1] and len(results[0]) == 20 and results[0][-1] == 11
    assert warc.mark_revisits(made.limit(0).drop("payload"), made.limit(0)).count() == 0


# --- mixing and sharding ---


def test_raked_margins(spark):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randrange(1, 400), rng.choice(["en", "en", "fr", None]), rng.choice(["a", "a", "a", "b", "c"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    goal = {"source": {"a": 1.0, "b": 1.0, "c": 2.0, "gone": 5.0}, "lang": {"en": 3.0, "fr": 2.0, mixing.NONE: 1.0}}
    targets = {d: spark.createDataFrame(list(g.items()), f"{d} string, target double") for d, g in goal.items()}
    out = mixing.mix(df, {"source": F.col("source"), "lang": F.col("lang")}, mixing.approximate_tokens("text"), targets).toPandas()
    assert len(out) == 3000 and out.probability.between(0, 1).all()
    out["e"], out["k"] = out.tokens * out.probability, out.tokens * out.kept
    for d, g in goal.items():
        shares = out.assign(c=out[d].fillna(mixing.NONE)).groupby("c")[["e", "k"]].sum()
        shares = shares / shares.sum()
        total = sum(v for k, v in g.items() if k in shares.index)
        for c in shares.index:
            assert shares.e[c] == pytest.approx(g[c] / total, abs=1e-5) and shares.k[c] == pytest.approx(g[c] / total, abs=0.08)
    assert mixing.mix(df.limit(0), {"source": F.col("source")}, mixing.approximate_tokens("text")).count() == 0


def test_targets_that_contradict_each_other(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("b", "y", 10)], "source string, lang string, tokens long")
    targets = {"source": spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, target double"), "lang": spark.createDataFrame([("x", 1.0), ("y", 1.0)], "lang string, target double")}
    with pytest.warns(UserWarning, match="cannot all be met"):
        out = {r["source"]: r["weight"] for r in mixing.rake(cells, targets).collect()}
    assert out == pytest.approx({"a": 1.0, "b": 1.0})  # the last dimension's targets hold
    assert mixing.rake(cells.limit(0), targets).count() == 0


def test_mixing_query_against_plain_raking(spark):
    """op7 against raking in plain Python: same cells, own counts, many rounds."""
    got = {r["doc_id"]: r for r in queries.op7_ipf_mixing(spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert set(got) == {r["doc_id"] for r in rows} and len(got) == len(rows)

    def topic(t):
        n = len(t) + 1
        share = lambda chars: sum(c in chars for c in t) / n
        return "figures" if share("0123456789") > 0.04 else "markup" if share("{}<>=;|#%&*$") > 0.03 else "lists" if share("\n") > 0.015 else "notes" if n < 400 else "prose"

    cells, of = {}, {}
    for r in rows:
        of[r["doc_id"]] = c = (r["source"], r["lang"], topic(r["text"] or ""))
        tokens = max(1, -(-len((r["text"] or "").encode()) // 4))
        cells[c] = cells.get(c, 0) + tokens
        assert (got[r["doc_id"]]["source"], got[r["doc_id"]]["lang"], got[r["doc_id"]]["topic"], got[r["doc_id"]]["tokens"]) == (*c, tokens)
    whole, weight = sum(cells.values()), dict.fromkeys(cells, 1.0)
    sums = lambda d, w: {v: sum(n * w[c] for c, n in cells.items() if c[d] == v) for v in {c[d] for c in cells}}
    goals = [{v: n**0.8 for v, n in sums(d, weight).items()} for d in range(3)]
    goals = [{v: n * whole / sum(g.values()) for v, n in g.items()} for g in goals]
    for _ in range(200):
        for d in range(3):
            have = sums(d, weight)
            weight = {c: w * goals[d][c[d]] / have[c[d]] for c, w in weight.items()}
    top = max(weight.values())
    for i, r in got.items():
        w = weight[of[i]]
        assert r["weight"] == pytest.approx(w, rel=1e-4) and r["probability"] == pytest.approx(w / top, rel=1e-4)
        assert r["copies"] in (int(w), int(w) + 1) and (not r["kept"] or r["copies"] > 0)
    assert sum(r["copies"] * r["tokens"] for r in got.values()) == pytest.approx(whole, rel=0.1)


def test_a_rare_cell_leaves_the_mix_whole(spark):
    import corpus_pipeline

    rows = [(i, "a word " * 20, "en", "ab"[i % 4 == 0], 140) for i in range(4000)] + [(9000, "once", "en", "rare", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix(df, {"source": F.col("source")}, mixing.approximate_tokens("text")).toPandas()
    assert out.probability.median() < 0.3  # the rare source rules a sample without copies
    assert (abs(out.copies - out.weight) < 1).all() and (out.copies[out.kept] > 0).all()
    assert (out.tokens * out.copies).sum() == pytest.approx(out.tokens.sum(), rel=0.03)
    got, want = ((out.tokens * out[c]).groupby(out.source).sum() / out.tokens.sum() for c in ("copies", "weight"))
    assert (abs(got - want) < 0.03).all() and out.copies[out.source == "rare"].iloc[0] > 1
    mixed = corpus_pipeline.mixing(spark, df, "")
    assert mixed.count() == pytest.approx(len(rows), rel=0.03)
    coded = corpus_pipeline.bpe(spark, mixed, "")
    assert coded.count() == mixed.select("doc_id").distinct().count() and coded.agg(F.sum("copies")).first()[0] == mixed.count()


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_shards(spark, shards):
    rng = random.Random(shards)
    texts = [(i, "z" * rng.randrange(1, 60)) for i in range(1500)] + [(5000 + i, "hot text") for i in range(700)] + [(70007, None), (70007, None), (None, "n")]
    out = kd_tree_shards(docs(spark, texts), shards=shards).toPandas()
    assert len(out) == len(texts)
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == shards and sizes.max() - sizes.min() <= 0.02 * sizes.mean() + 130
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert (out[out.doc_id == 70007][["size", "text_crc32"]] == [1, 0]).all().all()
    by_target = kd_tree_shards(docs(spark, texts), target_bytes=int(out["size"].sum() / 4)).select("shard").distinct().count()
    assert by_target == 4 and kd_tree_shards(docs(spark, []), shards=4).count() == 0


def test_small_groups_stay_together(spark):
    rng = random.Random(11)
    texts = [(i, "".join(rng.choice("abcdef") for _ in range(rng.randrange(20, 400)))) for i in range(1200)]
    texts += [(10_000 + 3 * i + j, texts[i][1]) for i in range(100) for j in range(3)]
    out = kd_tree_shards(docs(spark, texts), shards=8, tolerance=0.05).toPandas()
    assert (out.groupby("text_crc32").shard.nunique() == 1).all()


def test_shard_query_is_a_tree_of_medians(spark):
    """op8 against its law in plain Python: every node's cut lies on its widest dimension, at its share of bytes, in order."""
    import zlib

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op8_kd_tree_shards(spark, DATA).collect()
    shard = {r["doc_id"]: r["shard"] for r in rows}
    assert len(rows) == len(texts) and all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)

    def dims(t):
        size, lines, words = len(t.encode()) + 1, t.count("\n"), t.count(" ") + t.count("\n") + 1
        return size, lines, words, (size - 1 - len(t)) * 1000 // size, len(t) * 100 // words

    meta = {i: dims(t) for i, t in texts.items()}
    span = lambda ids, d: max(meta[i][d] for i in ids) - min(meta[i][d] for i in ids)
    used, total = set(), sum(m[0] for m in meta.values())

    def descend(ids, first, n):
        if n == 1:
            assert {shard[i] for i in ids} == {first}
            return
        width = [span(ids, d) / max(1, span(meta, d)) for d in range(5)]
        d = width.index(max(width))
        used.add(d)
        key = lambda i: (meta[i][d], zlib.crc32(texts[i].encode()), i)
        left = [i for i in ids if shard[i] < first + n // 2]
        right = [i for i in ids if shard[i] >= first + n // 2]
        assert max(map(key, left)) < min(map(key, right))
        goal, have = sum(meta[i][0] for i in ids) * (n // 2) / n, sum(meta[i][0] for i in left)
        assert abs(have - goal) <= 0.002 * total / 16 + max(meta[i][0] for i in ids)
        descend(left, first, n // 2)
        descend(right, first + n // 2, n - n // 2)

    descend(list(texts), 0, 16)
    assert len(used) > 1


# --- queries and pipeline ---


def test_queries_with_sql(spark):
    import duckdb

    from tests.test_queries import TABLES, compare

    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        compare(spark, duck, queries.QUERIES[name], sql)


def test_pipeline(spark):
    import corpus_pipeline as p
    from lotlens.llm.common import materialise
    from lotlens.llm.simhash import jaccard

    whole = spark.read.parquet(f"{DATA}/documents.parquet")
    steps = [whole]
    for _, stage in p.STAGES:
        steps.append(materialise(stage(spark, steps[-1], DATA), "test"))
    assert all(s.columns == p.COLUMNS for s in steps[:-1])
    rows = [{r["doc_id"]: r for r in s.collect()} for s in steps]
    assert all(set(b) <= set(a) for a, b in zip(rows, rows[1:], strict=False))
    assert len(rows[1]) > 0.8 * len(rows[0])
    assert {r["text"] for r in rows[2].values()} == {r["text"] for r in rows[1].values()} and len({r["text"] for r in rows[2].values()}) == len(rows[2])
    ids = sorted(rows[2])
    alike = {i: i for i in ids}
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if jaccard(rows[2][i]["text"], rows[2][j]["text"]) >= 0.8:
                a, b = sorted((alike[i], alike[j]))
                alike = {k: a if v == b else v for k, v in alike.items()}
    assert set(rows[3]) == set(alike.values())
    assert p.run(spark, DATA).count() == len(rows[5])


def test_pipeline_on_odd_corpora(spark):
    """Nulls in any column, repeated rows, empty and long texts, clashing columns, an empty table: each stage's stated result."""
    import corpus_pipeline as p

    from lotlens.llm.common import materialise

    kind = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, token_ids string, root long"
    prose = " ".join(f"w{i}" for i in range(120))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one", "en", None, 3), (3, "one", "en", None, 3), (4, "one", None, "a", 3), (None, "lone text of its own", "en", "a", 1),
            (5, prose, "en", "a", 1), (6, prose + " more", "en", "a", 1), (7, "long " * 100_000, "en", "b", 1), (None, "one", "fr", "b", 3)]
    df = materialise(spark.createDataFrame([(*r, "x", "x", "x", 9) for r in rows], kind), "test")
    said = {}
    for name, stage in p.STAGES:
        assert materialise(stage(spark, df.limit(0), DATA), "test").count() == 0
        df = materialise(stage(spark, df, DATA), "test")
        said[name] = df.collect()
        if name != "byte-level BPE":
            assert df.columns == p.COLUMNS
    assert len(said["toxicity"]) == len(rows)
    exact = sorted(((r["doc_id"], (r["text"] or "")[:5]) for r in said["exact dedup"]), key=str)
    assert exact == sorted([(2, ""), (4, "one"), (None, "lone "), (5, "w0 w1"), (6, "w0 w1"), (7, "long ")], key=str)
    assert sorted((r["doc_id"] for r in said["SimHash near-dedup"]), key=str) == sorted([2, 4, None, 5, 7], key=str)
    assert {r["doc_id"] for r in said["byte-level BPE"]} <= {2, 4, None, 5, 7} and len({r["doc_id"] for r in said["byte-level BPE"]}) == len(said["byte-level BPE"])


def test_bpe_query_equals_the_library(spark):
    """op9 over all documents."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in queries.op9_bpe_merge_replay(spark, DATA).collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        ids = want.encode_ordinary(t)
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"], rows[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
