"""Operators keep whole texts and all rows."""

import json

SF = "/root/testdata/sf0.001"


def test_chat_keeps_every_turn(spark):
    from merrow.llm.queries import QUERIES

    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    out = QUERIES["op9_chat"](spark, SF).collect()
    calls = {(r.conv_id, r.turn): r for r in out if r.status != "no_call"}
    rest = {(r.call_id, r.result_turn): r.content for r in out if r.status == "no_call"}
    assert len(calls) == sum(t.role == "assistant" for t in turns) and any(t.role == "system" for t in turns)
    texts = lambda x: [x] if isinstance(x, str) else [y for v in x.values() for y in texts(v)] if isinstance(x, dict) else []
    for t in turns:
        if t.role == "assistant":
            assert t.text in texts(json.loads(calls[t.conv_id, t.turn].message)["arguments"])
        elif before := calls.get((t.conv_id, t.turn - 1)):
            assert json.loads(before.message)["result"]["content"] == t.text
        else:
            assert rest[f"call:{t.conv_id}:{t.turn - 1}", t.turn] == t.text
            assert any((r.conv_id, r.result_turn) == (t.conv_id, t.turn) for r in out if r.status == "no_call")
    assert any("query: longer than 200" in (r.errors or "") for r in out)


def test_chat_null_and_repeated_places(spark):
    from merrow.llm.chat import calls_in, link_calls

    # every row of the output can be put back into its conversation
    turns = spark.createDataFrame([(1, 0, "system", "be brief", "x"), (1, 1, "user", "hello", "y"), (2, 5, "user", "w " * 200_000, "z")], "conv_id long, turn long, role string, text string, call_id string")
    back = link_calls(*calls_in(turns)).collect()
    assert sorted((r.conv_id, r.result_turn, len(r.content)) for r in back) == [(1, 0, 8), (1, 1, 5), (2, 5, 400_000)]
    rows = [(None, 1, "assistant", "a"), (None, 1, "assistant", "b"), (None, 1, "assistant", "b"), (1, None, "assistant", "c"), (1, 1, "assistant", "d"), (1, 1, "assistant", "e"), (1, 2, "user", "f"), (1, 2, "user", "g"), (1, 2, "system", "h"), (None, 2, "user", "i"), (2, 0, None, "j")]
    got = link_calls(*calls_in(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert sum(r.status != "no_call" for r in got) == 6 and len({r.message for r in got if r.message}) == 5
    assert sorted((r.call_id or "", r.content) for r in got if r.content) == [("", "i"), ("call:1:1", "f"), ("call:1:1#2", "g"), ("call:1:1#3", "h"), ("call:2:-1", "j")]


def brute_gone(texts, words=50):
    """Lines (id, place) in a run of two or more lines with over ``words`` words that stands before."""
    lines = {k: t.split("\n") for k, t in texts.items()}
    first, gone = {}, set()
    for k in sorted(lines):
        for i in range(len(lines[k])):
            n = 0
            for e in range(i, len(lines[k])):
                n += len(lines[k][e].split())
                if n > words and e > i:
                    run = tuple(lines[k][i : e + 1])
                    d, at = first.setdefault(run, (k, i))
                    if d != k or i >= at + len(run):
                        gone.update((k, j) for j in range(i, e + 1))
    return gone


def test_repeated_passages_of_few_lines(spark):
    import random

    from merrow.llm.line_dedup import dedup_lines

    rng = random.Random(5)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    texts = {}
    for size in range(2, 7):
        for turn in range(8):
            passage = [line(54 // size + rng.randrange(3)) for _ in range(size)]
            if sum(len(x.split()) for x in passage) <= 50:
                passage[0] += " " + line(20)
            for _ in range(3):
                texts[len(texts)] = "\n".join([line(4) for _ in range(rng.randrange(3))] + passage + [line(5) for _ in range(rng.randrange(3))])
    texts[len(texts)] = "\n".join(["again and again"] * 60)
    texts[len(texts)] = "\n".join(["short", line(20)])
    texts[len(texts)] = texts[0] + "\n\nbetween\n\n" + texts[3]
    rows = spark.createDataFrame([*texts.items(), (None, texts[1]), (1000, None), (1001, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in dedup_lines(rows, passages=True).collect()}
    gone = brute_gone(texts)
    chunks = {r.doc_id: r.n_removed_lines for r in dedup_lines(rows).collect()}
    for k, text in texts.items():
        left = [x for j, x in enumerate(text.split("\n")) if (k, j) not in gone]
        mine = got[k].text.split("\n") if got[k].text else []
        assert set(mine) <= set(left) and got[k].n_removed_lines >= chunks[k]
        assert got[k].n_lines == len(text.split("\n")) and got[k].n_removed_lines == got[k].n_lines - len(mine)
        if not chunks[k]:
            assert mine == left
    assert len(gone) > sum(chunks[k] for k in texts)
    assert got[1000].text is None and got[1001].text == ""
    kept = {x for r in got.values() if r.text for x in r.text.split("\n")}
    assert kept >= {x for t in texts.values() for x in t.split("\n")}


def brute_chunks(texts, divisor=3):
    """Lines (id, place) of chunks that stand before, and how many chunks each text has and loses."""
    import hashlib

    seen, gone, counts = set(), set(), {}
    for k in sorted(texts):
        lines, chunks, before = texts[k].split("\n"), [], None
        for i, line in enumerate(lines):
            h, is_long = int(hashlib.md5(line.encode()).hexdigest()[:7], 16), len(line.split()) >= 50
            if before is None or is_long or before[1] or (31 * before[0] + h) % divisor == 0:
                chunks.append([])
            chunks[-1].append(i)
            before = (h, is_long)
        lost = 0
        for c in chunks:
            body = "\n".join(lines[i] for i in c)
            if (len(c) > 1 or len(body.split()) >= 50) and body.split():
                if body in seen:
                    lost += 1
                    gone.update((k, i) for i in c)
                seen.add(body)
        counts[k] = (len(chunks), lost)
    return gone, counts


def test_line_dedup_leaves_only_the_tables_that_its_result_reads(spark):
    from pathlib import Path

    from merrow.llm.line_dedup import dedup_lines
    from merrow.scratch import run_folder

    folder = Path(run_folder(spark).removeprefix("file:"))
    before = set(folder.glob("*")) if folder.exists() else set()
    passage = "\n".join(f"word{i} " * 12 for i in range(6))
    rows = spark.createDataFrame([(i, f"{passage}\nown line {i}") for i in range(4)], "doc_id long, text string")
    left = dedup_lines(rows, passages=True)
    there = {p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - before}
    assert there == {"gone-chunks", "gone-runs"}
    assert sorted(r.n_removed_lines for r in left.collect()) == [0, 6, 6, 6]


def test_line_dedup_query_by_brute_force(spark):
    """Chunks are told exactly; every line that goes stands before in a chunk or a long passage, and
    every line of a long repeated passage goes."""
    import hashlib

    from merrow.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by_chunk, counts = brute_chunks(texts)
    gone = by_chunk | brute_gone(texts)
    rows = QUERIES["op4_line_dedup"](spark, SF).collect()
    assert len(rows) == len(texts) and len(gone) > len(by_chunk)
    for r in rows:
        lines = texts[r.doc_id].split("\n")
        left = [x for i, x in enumerate(lines) if (r.doc_id, i) not in gone]
        assert (r.n_lines, r.n_chunks, r.n_removed_chunks) == (len(lines), *counts[r.doc_id])
        assert (r.n_removed_lines, r.text_sha256) == (len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()), r.doc_id


def test_texts_without_common_lines(spark):
    from merrow.llm.quality import without_common_lines

    rows = [(i, f"own {i}\n\nShared   LINE\nend {i}", h) for h in ("a", None) for i in range(21)] + [(100, "shared line\nx", "b"), (101, "shared line", "a"), (102, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.text or "", r.source or "") for r in without_common_lines(docs).collect())
    want = [(i, f"own {i}\n\nend {i}", h) for h in ("a", "") for i in range(21)] + [(100, "shared line\nx", "b"), (101, "", "a"), (102, "", "a")]
    assert got == sorted(want)


def test_chat_query_by_brute_force(spark):
    """Every column of op9_chat from the turns alone."""
    from merrow.llm.queries import QUERIES

    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    calls = {(t.conv_id, t.turn): t.text or "" for t in turns if t.role == "assistant"}
    others = {}
    for t in turns:
        if t.role != "assistant":
            others.setdefault((t.conv_id, t.turn - 1), []).append((t.turn, t.text or ""))

    def level(conv, turn):
        return 1 + level(conv, turn - 2) if (conv, turn - 2) in calls else 0

    want = {}
    for (conv, turn), text in calls.items():
        n = len(text.split(" "))
        name, errors = ("lookup", "count", "score")[n % 3], []
        if name == "lookup":
            arguments = {"limit": n % 50, "query" if n % 7 else "text": text}
            errors += ["query: missing", "not allowed: text"] if n % 7 == 0 else ["query: longer than 200"] if len(text) > 200 else []
            errors += ["limit: under 1"] if n % 50 == 0 else ["limit: over 40"] if n % 50 > 40 else []
        elif name == "count":
            arguments = {"text": text, "unit": "words" if n % 11 else "lines"}
            errors += [] if n % 11 else ["unit: not one of its values"]
        else:
            arguments = {"extra": {"at": 1, "text": text, "words": n}, "strict": n % 2 == 0, "value": n % 13 - 1}
            errors += ["value: under 0"] if n % 13 == 0 else []
        if n % 17 == 0:
            arguments, errors = text, ["arguments: no JSON object"]
        found = sorted(others.get((conv, turn), []))
        result = dict(zip(("turn", "content"), found[0], strict=True)) if found else {"turn": None, "content": None}
        message = {"arguments": arguments, "id": f"call:{conv}:{turn}", "name": name, "result": result}
        text_of = json.dumps(message, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        want[conv, turn] = (name, level(conv, turn), "linked" if found else "no_result", len(found), not errors, "; ".join(sorted(errors)), text_of)
    got = [r for r in QUERIES["op9_chat"](spark, SF).collect() if r.status != "no_call"]
    assert {(r.conv_id, r.turn): (r.name, r.level, r.status, r.n_results, r.valid, r.errors, r.message) for r in got} == want and len(got) == len(want)


def test_numbers_have_one_form(spark):
    from pyspark.sql import functions as F

    from merrow.llm.chat import canonical

    alike = [["100", "100.0", "1e2", "100.00", "1E+2", "10000e-2"], ["0", "0.0", "-0.0", "0e9"], ["-2.5", "-2.50", "-25e-1"], ["10000000000", "1e10", "10000000000.0"], ["1250000000000000000000", "1.25e21"]]
    rows = [(k, f'{{"x":[{number},"1.0e2 \\\\\\" 1.0"],"a":{number}}}') for k, group in enumerate(alike) for number in group]
    got = spark.createDataFrame(rows, "k int, j string").select("k", canonical(F.col("j")).alias("c")).distinct().collect()
    assert {r.k: r.c for r in got} == {k: f'{{"a":{group[0]},"x":[{group[0]},"1.0e2 \\\\\\" 1.0"]}}' for k, group in enumerate(alike)} and len(got) == len(alike)


def test_language_rows_of_one_id_and_without(spark):
    """A repeated or missing id neither keeps a language out nor brings more rows than the bound."""
    import pytest
    from pyspark.sql import functions as F

    from merrow.llm import language

    english = [(7, f"the house and the garden number {i} are over there with them", "en") for i in range(400)]
    spanish = [(k, f"la casa y el jardin numero {k} estan ahora con ellos siempre", "es") for k in range(100, 130)]
    rows = spark.createDataFrame([*english, *spanish, (None, "der hund und die katze", "de"), (8, None, "en"), (9, "", "fr")], "doc_id long, text string, lang string")
    assert [r.h for r in spark.range(7, 8).select(language.held_out(F.col("id")).alias("h")).collect()] == [False]
    model = language.learn(rows, rows_per_language=50)
    got = {(r.doc_id, r.lang): r.lang_pred for r in language.identify(rows, model).collect()}
    assert got[7, "en"] == "en" and got[100, "es"] == "es" and got[8, "en"] == "und" and got[9, "fr"] == "und"
    copies = spark.createDataFrame(english[:1] * 900, "doc_id long, text string, lang string")
    assert language.learn(copies, rows_per_language=50).families.labels == ["germanic"]
    with pytest.raises(ValueError, match="more than"):
        language.learn(spark.createDataFrame([(k, "some text here", f"l{k}") for k in range(600)], "doc_id long, text string, lang string"))


def test_pipeline_stages_on_odd_rows(spark):
    """No label, nulls, empty and repeated rows: clean rows stay, and nothing fails."""
    import corpus_pipeline

    rows = [(1, "one fine day in the garden", None, "s", 1), (1, "one fine day in the garden", None, "s", 1), (2, None, None, None, None), (3, "", None, "s", 0), (None, "no id at all here", None, "s", 3), (4, "12 34", None, "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and {r.doc_id for r in out.collect()} >= {1, None}, name
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)
    assert sorted(r.text for r in corpus_pipeline.language_id(spark, docs, SF).collect()) == ["no id at all here", *["one fine day in the garden"] * 2]


def test_pipeline_keeps_columns_of_any_name(spark):
    """Columns named as the operators' results, and a very long text, come through every stage."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    names = ("score", "lang_pred", "n_words", "n_hit", "items", "spans", "contaminated", "n_lines", "n_chunks", "component_id", "__other_0", "__text")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = docs.limit(1).select(F.lit(10**6).cast("long").alias("doc_id"), F.concat_ws(" ", "text", F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.concat(F.lit("word"), i))).alias("text"), "lang", "source", "n_chars")
    docs = docs.unionByName(long).withColumns({n: F.concat(F.lit(f"{n}:"), "doc_id") for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        wrong = [F.count_if(F.col(f"`{n}`") != F.concat(F.lit(f"{n}:"), "doc_id")) for n in names]
        assert tuple(out.agg(F.count_if(F.col("doc_id") == 10**6), *wrong).first()) == (1, *[0] * len(names)), name
