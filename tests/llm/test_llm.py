"""The training-data operators against their libraries, brute force, SQL and round trips; and the cases at the edges."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

import corpus_pipeline
from gridmill.llm import audio, bpe, chat, common, components, decontam, html, neardup, pii, quality, queries, tokenfile, urls

ODD = [None, "", " ", "\n\n a \t b", "<|endoftext|>", "x<|endoftext|>y <|endoftext|>", "naïve café ½ ٣٤ 漢字かな 한글 🙂‍🙂 \u0558 \ua7cf", "it's they'll 'S 1234 --- ...", "\u00a0\u2003x\u0085y", "a" * 5000, "word " * 3000, "\0\x01", "\ufffd𝕏𝔘"]


def table(spark, texts, extra=True):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no key"), (1, "again"), (1, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = "key ids n part chunk g id dest blob score words digest rep u entry value".split()
    return df.withColumns({n: F.lit(7) for n in names}) if extra else df


@pytest.fixture(scope="session")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def test_splitters_agree_on_the_characters_taken_as_alike(library):
    words, quick = bpe.WordTokenizer(bpe.default_tokenizer()), tokenfile.FastEncoder(bpe.default_tokenizer())
    alike = re.compile(f"[{bpe.ALIKE}]")
    for cp in [*range(0xD800), *range(0xE000, 0x20000)]:
        if alike.match(chr(cp)):
            text = f"a{chr(cp)}1 b{chr(cp)}{chr(cp)} c"
            assert words.find(text) == [text[i:j] for _, (i, j) in words.split(text)], hex(cp)
            assert quick.quick.encode_ordinary(text) == library.encode(text, add_special_tokens=False).ids, hex(cp)


def test_bpe_is_the_library(spark, small, library):
    docs = table(spark, ODD)
    got = bpe.decode(bpe.encode(docs, part_bytes=1000)).collect()
    assert len(got) == docs.count()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    for r in got:
        want = {library.decode(e.ids, skip_special_tokens=False): e.ids for e in library.encode_batch(texts[r.doc_id], add_special_tokens=False)}
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.decoded]
        assert r.n_tokens == len(want[r.decoded])
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in bpe.op2_bpe(spark, small).collect():
        e = library.encode(rows[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(docs.limit(0)).count() == 0


def test_a_chunk_made_anew_in_another_order_is_an_error():
    import pyarrow as pa
    import pyarrow.compute

    def made(texts):
        class Context:
            partitionId = staticmethod(lambda: 0)  # noqa: N815

        bpe.TaskContext.get, kept = staticmethod(lambda: Context), bpe.TaskContext.get
        try:
            batch = pa.RecordBatch.from_pydict({"key": pa.array(range(len(texts)), pa.int64()), "text": texts})
            return pa.Table.from_batches(list(bpe._chunks(bpe.default_tokenizer(), 8)([batch])))
        finally:
            bpe.TaskContext.get = kept

    a, b = made(["one two", "three two"]), made(["three two", "one two"])
    finish = bpe._join_back(None, bpe._ENCODED)
    for rows, good in ((a, True), (b, False)):
        chunk = next(a.slice(i, 1) for i in range(a.num_rows) if a.column("part")[i].as_py() < 0)
        words = [x for part in range(8) for x in bpe._encode_part(bpe.default_tokenizer())(rows.filter(pa.compute.equal(rows.column("part"), part)).to_batches())]
        if good:
            assert finish(pa.Table.from_batches(words), chunk).num_rows == 2
        else:
            with pytest.raises(RuntimeError):
                finish(pa.Table.from_batches(words), chunk)


def test_word_codes_of_any_size():
    codes = np.array([0, 239, 240, 65535, 65536, (15 << 16) - 1, 15 << 16, 1 << 24], np.uint32)
    assert (bpe._unpack_codes(*bpe._pack_codes(codes.copy())) == codes).all()


def test_token_files(spark, small, library, tmp_path, monkeypatch):
    docs, folder = table(spark, ODD), f"file://{tmp_path}/t"
    manifest = tokenfile.write(docs, folder, shard_bytes=300, task_bytes=1 << 14)
    got = sorted(tokenfile.read(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in docs.collect()), key=lambda k: (k is not None, k))
    shards = manifest.orderBy("shard").collect()
    assert len(shards) > 1 and [r.shard for r in shards] == list(range(len(shards)))
    assert [r.start for r in shards] == [sum(s.n_tokens for s in shards[:i]) for i in range(len(shards))]
    short = tokenfile.read(manifest, folder, columns=("ids_crc32", "start"))
    assert short.columns == ["doc_id", "ids_crc32", "start"] and sorted(map(tuple, short.collect()), key=lambda r: r[2]) == [(r.doc_id, r.ids_crc32, r.start) for r in got]
    monkeypatch.setattr(tokenfile, "RANGES_EACH", 1)
    monkeypatch.setattr(tokenfile, "READ_BYTES", 1)
    again = tokenfile.write(docs, folder + "2", shard_bytes=300, task_bytes=1 << 14)
    assert sorted((r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.read(again, folder + "2").collect()) == [(r.start, r.n_tokens, r.ids_crc32) for r in got]
    assert tokenfile.read_dictionary(folder) == tokenfile.read_dictionary(folder + "2")
    start = 0
    for r in got:
        assert (r.start, r.n_tokens) == (start, len(r.ids) // 4)
        start += r.n_tokens
    dictionary = tokenfile.read_dictionary(folder)
    first = manifest.orderBy("shard").collect()[-1]
    last = tokenfile.read_document(folder, first.file, first.n_docs - 1, dictionary)
    assert last.tobytes() == got[-1].ids
    with pytest.raises(ValueError):
        tokenfile.read_document(folder, first.file, 0, dictionary + b"x")
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    start, want = 0, {}
    for i, t in rows:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.op3_tokenfile(spark, small).collect()} == want
    empty = tokenfile.write(docs.limit(0), f"file://{tmp_path}/e")
    assert tokenfile.read(empty, f"file://{tmp_path}/e").count() == 0


def least_edits(item, text):
    """The least edits that turn item into a stretch of text."""
    cost = np.zeros(len(text) + 1, int)
    t = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    for i, c in enumerate(item, 1):
        step = np.minimum(cost[:-1] + (t != ord(c)), cost[1:] + 1)
        new = np.concatenate(([i], step))
        cost = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(cost.min())


def held_items(text, items):
    """(item, least edits) of the items that a text holds by the rules, each looked at by itself."""
    text, out = decontam.normalise(text), {}
    for i, item in items:
        item = decontam.normalise(item)
        if not item:
            continue
        if len(item) < decontam.SHORT_CHARS:
            if f" {item} " in f" {text} ":
                out[i] = 0
        elif (edits := least_edits(item, text)) <= decontam.budget(len(item))[0]:
            out[i] = edits
    return out


@pytest.mark.parametrize(("block", "wave"), [(2 << 20, 4), (60, 1), (60, 2)])
def test_decontamination_finds_all_within_the_budget(spark, tmp_path, monkeypatch, block, wave):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", block)
    monkeypatch.setattr(decontam, "WAVE", wave)
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdehilnorst") for _ in range(r.randrange(1, 8)))
    items = [" ".join(word() for _ in range(n)) for n in (5, 8, 14, 30, 60)] + ["tiny one", "q", "q7!", "漢", "漢字", "Is it so?"]
    items += ["".join(r.choice("abcde ") for _ in range(n)).strip() for n in range(1, 31)]
    texts = []
    for _ in range(80):
        item = list(r.choice(items))
        for _ in range(r.randrange(0, 1 + int(0.12 * len(item)))):
            p = r.randrange(len(item))
            item[p : p + 1] = r.choice([[], ["z"], [item[p], "q"]])
        texts.append(" ".join(word() for _ in range(r.randrange(0, 40))) + " " + "".join(item).upper() + "! " + " ".join(word() for _ in range(20)))
    texts += [None, "", items[0], "\n".join(items), " ".join(items[3:4] * 3), "xq", "q", "is it, so", "漢字", "漢 字"]
    docs = table(spark, texts).where("doc_id is not null")
    bench = [*enumerate(items), (90, None), (91, "?!"), (0, items[0])]
    frame = spark.createDataFrame(bench, "item_id long, text string").coalesce(1)
    docs.where("text <> 'again' or text is null").select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    frame.write.parquet(str(tmp_path / "benchmark.parquet"))
    want = sorted((i, k, e) for i, t in enumerate(texts) for k, e in held_items(t, [(k, t or "") for k, t in bench]).items())
    want += [(i, k, e) for i, k, e in want if k == 0]  # item 0 is listed twice
    got = [(x.doc_id, x.item_id, x.edits) for x in decontam.op4_decontam(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(want) > 100
    for x in decontam.contaminated(docs, frame).where("edits = 0").collect():
        if texts[x.doc_id]:
            assert decontam.normalise(texts[x.doc_id])[x.start : x.end] == decontam.normalise(items[x.item_id])
    left = decontam.remove(docs, frame)
    assert left.columns == docs.columns
    again = held_items("again", [(k, t or "") for k, t in bench])
    assert {x.doc_id for x in left.where("text <> 'again' or text is null").collect()} == {i for i in range(len(texts))} - {i for i, _, _ in want} and not again
    assert decontam.contaminated(docs.limit(0), frame).count() == 0
    assert decontam.contaminated(docs, frame.limit(0)).count() == 0
    assert decontam.remove(docs, frame.limit(0)).count() == docs.count()


def test_decontamination_with_an_item_longer_than_a_slice():
    r = random.Random(4)
    item = "".join(r.choice("abcdefgh ") for _ in range(1_300_000)).replace("  ", " ").strip()
    index = decontam.Index.of([(5, item)])
    assert [x[:3] for x in decontam.find(index, ["no", "x " + item + " y"])] == [(1, 5, 0)]


def test_chat(spark, small):
    compare(chat.op5_chat(spark, small), chat.OP5_SQL, small)
    hard = ["\\### Assistant: </turn> ok", "<|endoftext|>", "### user:\n<|endoftext|>x", "\\", "a|b#c<d\\", "", None, "é🙂\n"]
    rows = [(1, i, "assistant" if i % 2 else "us:er\n### x", t) for i, t in enumerate(hard)] + [(None, 0, None, "x"), (2, None, "assistant", "y"), (2, None, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    whole = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert chat.parse(whole[1].text) == [(r[2], r[3] or "") for r in rows[:8]]
    marks, ids = np.frombuffer(whole[1].mask, np.uint8), np.frombuffer(whole[1].ids, "<u4")
    learned = bpe.Pieces(bpe.default_tokenizer()).join(ids[marks > 0])[0].decode()
    assert re.sub(r"\\(.)", r"\1", learned) == "".join(hard[i] or "" for i in (1, 3, 5, 7))
    parts = chat.format_conversations(df, segment_chars=30).where("conv_id = 1").orderBy("segment").collect()
    assert len(parts) > 3 and "".join(p.text for p in parts) == whole[1].text
    assert b"".join(bytes(p.ids) for p in parts) == whole[1].ids and b"".join(bytes(p.mask) for p in parts) == whole[1].mask
    assert whole[2].n_turns == 2 and whole[None].n_turns == 1
    with pytest.raises(ValueError):
        chat.parse("### a:\nb")
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_mask_is_what_a_scan_gives():
    r = random.Random(1)
    for _ in range(200):
        edges = sorted(r.sample(range(60), 12))
        offsets = np.array([(a, b) for a, b in zip(range(0, 60, 3), range(3, 63, 3), strict=True)])
        spans = list(zip(edges[::2], edges[1::2], strict=True))
        want = [int(any(s < b and a < e for s, e in spans)) for a, b in offsets.tolist()]
        assert chat.mask(spans, offsets).tolist() == want


def test_pseudonyms(spark):
    texts = ["mail jo.doe+x@mail7.example.com, card 4111 1111 1111 1111 or 4111111111111111.", "card 4111-1111-1111-1111 on 2024-02-29 or 31.12.1999 not 2024-02-30", "ip 10.0.0.1 not 999.1.1.1; +1 (974) 555-3436 10.0.0.1", 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"', "ssn 123-45-6789 iban GB82WEST12345698765432", "no data, version 2.0, 3 apples", "9807915762804490!! 010.0.0.1, 1.2.2024 and 4111111111111112"]
    docs = table(spark, [*texts, None, ""])
    out = pii.pseudonymise(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.where("doc_id <> 1").collect()}
    for i, t in enumerate(texts):
        new = pii.mask_text(t)[0]
        assert i == 1 or got[i] == new
        assert pii.mask_text(new, back=True)[0] == t
        assert re.sub(r"\w", "x", new) == re.sub(r"\w", "x", t) or i == 2
    assert got[len(texts)] is None and got[len(texts) + 1] == "" and got[5] == texts[5]
    digits = lambda s: re.sub(r"\D", "", s)
    cards = [digits(re.search(r"card ([\d -]+\d)", pii.mask_text(t)[0])[1]) for t in texts[:2]]
    assert cards[0] == cards[1] != "4111111111111111" and pii.luhn(cards[0])
    assert pii.mask_text(texts[6])[1] == {"date": 1} and all(v in pii.mask_text(texts[6])[0] for v in ("9807915762804490!! 010.0.0.1, ", " and 4111111111111112"))
    same = [pii.mask_text(m)[0] for m in ("Jo.Doe@Mail.example.org", "jo.doe@mail.example.org", "JO.DOE@mail.EXAMPLE.org")]
    assert len({m.lower() for m in same}) == 1 and [re.sub("[a-z]", "x", re.sub("[A-Z]", "X", m)) for m in same][0] == "Xx.Xxx@Xxxx.xxxxxxx.xxx"
    assert [pii.mask_text(m, back=True)[0] for m in same] == ["Jo.Doe@Mail.example.org", "jo.doe@mail.example.org", "JO.DOE@mail.EXAMPLE.org"]
    assert "2024-02-30" in pii.mask_text(texts[1])[0] and "999.1.1.1" in pii.mask_text(texts[2])[0]
    assert pii.mask_text(texts[0], b"other key")[0] != pii.mask_text(texts[0])[0]


def slow_values(text):
    """E-mail addresses, card numbers, IP addresses and days in a text, by walking over it and asking other validators."""
    import datetime
    import ipaddress

    out = {"email": [], "card": [], "ip": [], "date": []}
    for at in [i for i, c in enumerate(text) if c == "@"]:
        i, j = at, at + 1
        while i and (text[i - 1].isalnum() or text[i - 1] in "_.%+-"):
            i -= 1
        while j < len(text) and (text[j].isascii() and text[j].isalnum() or text[j] in ".-"):
            j += 1
        domain = text[at + 1 : j].rstrip(".")
        if i < at and "." in domain and all(domain.split(".")):
            out["email"].append(text[i:at] + "@" + domain)
    for word in text.split():
        word = word.strip('.,;:!?()[]"\'')
        if 13 <= len(word) <= 19 and word.isascii() and word.isdigit():
            total = 0
            for k, d in enumerate(reversed(word)):
                d = int(d) * (1 + k % 2)
                total += d - 9 * (d > 9)
            if total % 10 == 0:
                out["card"].append(word)
        elif word.count(".") == 3:
            try:
                out["ip"].append(str(ipaddress.IPv4Address(word)))
            except ValueError:
                pass
        else:
            for form in ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%d/%m/%Y"):
                try:
                    datetime.datetime.strptime(word, form)
                    out["date"].append(word)
                    break
                except ValueError:
                    pass
    return out


def test_op6_against_a_slow_search(spark, tmp_path):
    src = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    more = ["on 2024-02-29, 03/25/2021 or 31.12.1999.", "not 2024-02-30", "a@b.org a@b a@.c x..y@z.co.uk", "4111111111111111 4111111111111112", "10.0.0.1 10.9.0.256 010.2.0.1"]
    src |= {-1 - i: t for i, t in enumerate(more)}
    spark.createDataFrame(list(src.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in pii.op6_pii(spark, str(tmp_path)).collect()}
    assert got.keys() == src.keys()
    seen, pseudonyms = 0, {}
    for i, text in src.items():
        new, found = got[i].text, slow_values(text or "")
        assert pii.mask_text(new, back=True)[0] == text and (len(new) == len(text) or got[i].n_ip)
        for kind, values in found.items():
            assert got[i][f"n_{kind}"] >= len(values), (kind, values)
            for v in values:
                seen += 1
                assert v not in new
        for kind in ("card", "date", "ip"):
            after = slow_values(new)[kind]
            if kind != "date":
                assert len(after) == len(found[kind])
            for v, w in zip(found[kind], after, strict=False):
                assert kind == "date" or pseudonyms.setdefault((kind, v), w) == w
        if not any(got[i][f"n_{k}"] for k in pii.KINDS):
            assert new == text
    assert seen > 30 and len(set(pseudonyms.values())) == len(pseudonyms)


def test_permutation_is_one_to_one():
    seen = {pii.permute(f"{i:03d}", b"k", "t") for i in range(1000)}
    assert len(seen) == 1000 and all(len(s) == 3 for s in seen)
    days = {pii._date(f"20{y:02d}-0{m}-1{d}", b"k", False) for y in range(30) for m in range(1, 10) for d in range(10)}
    assert len(days) == 2700


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in list(parent))
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_components(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(common.LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, 48), (5, 80, 6), (4, 80, 3)])
def test_near_duplicates(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(neardup, "MEMBERS", block)  # many cells also in small groups
    monkeypatch.setattr(neardup, "PIVOTS", max(1, block // 3))
    if block < 6:
        monkeypatch.setattr(neardup, "CELL_BYTES", 3000)
        monkeypatch.setattr(neardup, "PIECE_BYTES", 40)
    r = random.Random(width)
    base = [[f"w{r.randrange(500)}" for _ in range(90)] for _ in range(4)]
    texts = {}
    for i in range(220):
        words = list(base[i % 4]) if i % 3 else [f"x{r.randrange(9000)}" for _ in range(r.randrange(1, 60))]
        for _ in range(r.randrange(0, 6)):
            words[r.randrange(len(words))] = f"n{r.randrange(99)}"
        texts[i + 10] = " ".join(words)
    texts |= {1: None, 2: "", 3: " \n\t ", 4: "Two words", 5: "two WORDS", 6: "two  words\n", 7: "é É", 8: "é é", 9: texts[10]}
    rows = [*texts.items(), (None, texts[10]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(1) for n in ("n", "g", "id", "rep", "key", "sig")})
    got = neardup.near_duplicates(df, width=width, percent=percent).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got if x.doc_id is not None} == brute_components(texts, width, percent)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got if x.doc_id is not None)
    assert [(x.component_id, x.kept) for x in got if x.doc_id is None] == [(None, True)] * 2


def thue_morse(n):
    """A word of n letters on which polynomial hashes modulo a power of two fail, and the one with its letters exchanged."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[v] for v in bits), "".join("ba"[v] for v in bits)


def test_different_words_are_not_linked(spark):
    rows = [(i * 10 + k, w) for i, n in enumerate((1024, 2048, 4096, 8192)) for k, w in enumerate(thue_morse(n))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id and r.kept for r in got)


@pytest.mark.parametrize("block", [48, 2])
def test_keys_with_several_texts_join_their_classes(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "MEMBERS", block)
    r = random.Random(9)
    text = {c: " ".join(f"{c}{r.randrange(99)}" for _ in range(40)) for c in "ABCDEFG"}
    near = text["D"].rsplit(" ", 1)[0]
    rows = [(2, "B"), (3, "C"), (5, "B"), (5, "C"), (7, "D"), (7, "E"), (8, "E"), (9, "F"), (9, "F"), (4, "G"), (4, "G")]
    df = spark.createDataFrame([(k, text[c]) for k, c in rows] + [(6, near), (6, None), (1, None), (1, "")], "doc_id long, text string")
    got = neardup.near_duplicates(df, width=3, percent=85).collect()
    assert len(got) == len(rows) + 4
    assert {(x.doc_id, x.component_id) for x in got} == {(1, 1), (2, 2), (3, 2), (5, 2), (4, 4), (6, 6), (7, 6), (8, 6), (9, 9)}


def test_near_duplicates_sql_and_empty(spark, small):
    compare(neardup.op7_neardup(spark, small), neardup.OP7_SQL, small)
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_quality(spark):
    d = "/root/testdata/sf0.1"
    got = quality.op8_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    good = np.mean([r.predicted == r.quality for r in got])
    assert len(got) > 500 and good > 0.97
    model = quality.train([b"good text here", b"BAD!! BAD!!"], np.array([1, 0]))
    out = {r.doc_id: r.score for r in quality.score(table(spark, ODD).where("doc_id <> 1"), model).collect()}
    assert all(0 <= s <= 1 for s in out.values()) and out[0] == out[2] != out[3]
    alone = {i: float(model.score([(t or "").encode()])[0]) for i, t in enumerate(ODD)}
    assert all(abs(out[i] - alone[i]) < 1e-9 for i in out)
    docs = table(spark, ODD)
    assert quality.keep(docs, model, 0.0).columns == docs.columns and quality.keep(docs, model, 0.0).count() == docs.count()
    none = quality.fit(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
    assert none.score([b"x"])[0] == 0.5


def slow_features(text):
    """The bucket numbers of each kind of feature, number by number."""
    m64 = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m64
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m64
        return x ^ (x >> 31)

    numbers = lambda n, seed: [mix((i * 0x9E3779B97F4A7C15 + seed) & m64) for i in range(1, n + 1)]
    byte, f = numbers(256, 1), [v | 1 for v in numbers(8, 23)]
    bucket = lambda h: ((h * 0x9E3779B97F4A7C15) & m64) >> (64 - quality.BITS)
    words = [mix((sum(byte[b] * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(w)) + len(w)) & m64) for w in re.findall(rb"[^\x20\x09-\x0D]+", text)]
    out = [[bucket(w) for w in words], [bucket((a * f[0] + b * f[1]) & m64) for a, b in zip(words, words[1:], strict=False)], [bucket(((a == b) * f[2] + f[3]) & m64) for a, b in zip(words, words[1:], strict=False)]]
    for n in quality.GRAMS:
        grams = []
        for i in range(len(text) - n + 1):
            h = 0
            for b in text[i : i + n]:
                h = (h * f[5] + byte[b] * f[4]) & m64
            grams.append(bucket(h))
        out.append(grams)
    return out


def test_scores_of_long_texts_in_pieces(monkeypatch):
    r = random.Random(12)
    model = quality.Model(np.random.default_rng(1).standard_normal(quality.BUCKETS).astype(np.float32), 0.1)
    texts = ["".join(r.choice(["a", "bb", "ccc", " ", "  ", "\n", "é", "x" * 30]) for _ in range(n)).encode() for n in (0, 1, 5, 40, 200, 1000)] + [b" " * 90, b"y" * 90, b"a " * 50 + b" " * 70 + b"b"]
    whole = model.score(texts)
    for size in (1, 7, 20, 64):
        monkeypatch.setattr(quality, "PIECE_BYTES", size)
        assert np.allclose(model.score(texts), whole, atol=1e-12)


def test_labels_are_learned_within_bounds(spark, monkeypatch):
    rows = [(i, "good words " * (i % 7 + 1)) for i in range(60)] + [(1, "again")] * 40 + [(None, "x"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, given: seen.append((texts, given.tolist())) or quality.Model(np.zeros(quality.BUCKETS, np.float32), 0.0))
    quality.fit(docs, labels)
    learned = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    assert len(seen[0][0]) == len(seen[0][1]) in (len(learned), len(learned) + 1) and seen[0][0].count(b"again") <= 1
    quality.fit(docs, labels, max_docs=10)
    monkeypatch.setattr(quality, "TRAIN_BYTES", 100)
    quality.fit(docs, labels)
    assert len(seen[1][0]) <= 10 and 0 < sum(map(len, seen[2][0])) <= 100
    got = {r.doc_id: r.held_out for r in docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out")).collect()}
    assert got[None] is False and all(got[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(60))


def test_features_by_brute_force():
    texts = [b"Aa bb bb", b"", b"  x ", "é é é".encode(), b"a" * 40 + b"\x0b\x0c q"]
    for text, kinds in zip(texts, quality.features(texts), strict=True):
        words = text.split()
        assert [len(k) for k in kinds] == [len(words), max(0, len(words) - 1), max(0, len(words) - 1), *(max(0, len(text) - n + 1) for n in quality.GRAMS)]
        assert [k.tolist() for k in kinds] == slow_features(text)


def test_html(spark, small):
    weights = html.train()
    rng, wrong, seen = np.random.default_rng(77), 0, 0
    for _ in range(200):
        page, labels = html.training_page(rng)
        found = html.blocks(page)
        if len(found) == len(labels):
            p = html.label([html.vectors(found, weights)], weights)[0] >= 0.5
            wrong, seen = wrong + int((p != np.array(labels)).sum()), seen + len(labels)
    assert seen > 2000 and wrong / seen < 0.01
    pages = "<nav><ul><li><a href=/x>of</a></li></ul></nav><article><h1>A &amp; B</h1><p>one<br>two <b>three<p>four\n\t five<!-- no <p>no</p> --></article><script>'<p>no</p>'</script><footer>&copy; no</footer>"
    cases = [pages, None, "", "plain <", "<p", "<article><p>cut off", "<style>p{}", "x" * 200_000, "<div>" * 3000 + "deep"]
    df = spark.createDataFrame([(i, None if i == 2 else "u", c) for i, c in enumerate(cases)] + [(0, "u", pages)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = [(r.page_id, r.text, r.n_chars) for r in html.main_text(df).collect()]
    assert got.count((0, "A & B one two three four five", 29)) == 2
    assert (1, "", 0) in got and (2, "", 0) in got and len(got) == 10
    for r in html.op9_html(spark, small).join(spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        from html import unescape

        assert r.text == " ".join(unescape(re.sub(r"<[^>]*>", " ", inner)).split())


def test_urls(spark, small):
    compare(urls.op10_urls(spark, small), urls.OP10_SQL, small)
    cases = [None, "", "x", "http://", "http://net", "http://NET/", "http://a.net/x", "http://xnet/", "ftp://Example.net/en/?q", "http://example.net/en", "http://a.b.example.com/de/x#y", "http://example.com:80/de/", "a://b://net/", "http://org/fr/\nx", "://net/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)] + [(0, None), (5, cases[5])], "page_id long, url string").withColumns({"host": F.lit(1), "path": F.lit(1), "entry": F.lit(1), "rule": F.lit(1)})
    listed = spark.createDataFrame(list(urls.RULES), "entry string, verdict string")
    got = {r.page_id: r.rule for r in urls.judge(df, listed).collect()}
    rules = [(e[: e.index("/")], e[e.index("/") :]) for e, _ in urls.RULES]
    for i, u in enumerate(cases):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [h + p for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (max(fits, key=len) if fits else None), u
    many = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit(".example/")).alias("entry"), F.lit("block").alias("verdict"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit(".example/x")).alias("url"))
    assert urls.judge(pages, many).where("verdict = 'block'").count() == 3000
    assert urls.judge(df, listed.limit(0)).where("verdict = 'allow'").count() == df.count()
    assert urls.judge(df.limit(0), listed).count() == 0


def test_audio(spark, small):
    rng = np.random.default_rng(2)
    songs = [audio.melody(rng.standard_normal(64).tolist()) for _ in range(30)]
    noisy = [np.clip(songs[i].astype(int) + rng.normal(0, 600, len(songs[i])), -32768, 32767).astype(np.int16) for i in range(3)]
    late = [np.concatenate((songs[k][: 5 * audio.HOP][::-1], songs[k])).astype(np.int16) for k in (3, 4)]
    recordings = dict(enumerate([*songs, *noisy, *late, songs[0]])) | {50: None, 51: np.zeros(10, np.int16), 52: np.zeros(90_000, np.int16)}
    df = spark.createDataFrame([(k, None if a is None else a.tobytes()) for k, a in recordings.items()], "key long, audio binary")
    prints = {r.key: np.frombuffer(r.codes, np.uint32) for r in audio.fingerprints(df).collect()}
    assert len(prints[50]) == len(prints[51]) == 0 and (prints[0] == prints[35]).all()
    classes = spark.createDataFrame([(k, c.tobytes()) for k, c in prints.items() if len(c) and k != 35], "id long, codes binary")
    got = {(r.query, r.id, r.offset) for r in audio.matches(classes, classes).collect()}
    assert {(0, 30, 0), (1, 31, 0), (2, 32, 0), (3, 33, -5)} <= got
    rows = audio.op1_audio(spark, small).collect()
    assert all((r.n_matches is None) == (r.vec_id % 20 != 0) for r in rows if r.match_id is None)
    assert sum(r.match_id is None for r in rows) == spark.read.parquet(f"{small}/embeddings.parquet").count()
    assert audio.melody(None) is None and len(audio.melody([])) == 0 and len(audio.melody([None, float("inf"), 0.0])) > 0


def test_pipeline_by_brute_force(spark, small, library):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    frame = spark.read.parquet(f"{small}/documents.parquet")
    model = quality.fit(frame, spark.read.parquet(f"{small}/labels.parquet"))
    kept = {i: r.text for i, r in docs.items() if model.score([r.text.encode()])[0] >= 0.3}
    parts = brute_components(kept, 5, 80)
    kept = {i: t for i, t in kept.items() if parts[i][1] == i}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if not held_items(t, bench)}
    want = {i: np.array(library.encode(pii.mask_text(t)[0], add_special_tokens=False).ids, "<u4").tobytes() for i, t in kept.items()}
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, small).collect()} == want
    assert len(want) < len(docs)
    rows = [(5, "one two three four five six"), (5, "one two three four five six"), (5, "other text that is no copy of it"), (7, "One two three four five six"), (8, ""), (8, ""), (None, "x"), (None, "x")]
    again = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    left = corpus_pipeline.keep_one_of_each(spark, again, small)
    assert left.columns == again.columns and sorted(left.select("doc_id", "text").collect(), key=repr) == sorted([(5, "one two three four five six"), (8, ""), (None, "x"), (None, "x")], key=repr)
    odd = spark.createDataFrame([(None, None, "en", None, None), (1, "", None, "s", 0), (1, "", None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for d in (odd, odd.limit(0)):
            out = stage(spark, d, small)
            assert out.columns == odd.columns
            out.count()


def test_every_query_is_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 11))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
