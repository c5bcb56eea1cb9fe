"""The training-data operators do the whole job: nothing that belongs to a result is left out."""

import time
import zlib

import numpy as np
import pytest

from gridmill.llm import audio, html, pii


def test_audio_returns_every_match(spark, tmp_path):
    rng = np.random.default_rng(3)
    song = rng.standard_normal(64)
    near = [song.copy() for _ in range(4)]
    for i, v in enumerate(near):
        v[i * 3] *= -1 if i else 1  # of the same size, so that all other notes stay
    rows = [(20 * i, v.tolist(), 0) for i, v in enumerate(near)] + [(7, near[0].tolist(), 0), (100, rng.standard_normal(64).tolist(), 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = audio.op1_audio(spark, str(tmp_path)).collect()
    row = {r.vec_id: r for r in got if r.match_id is None}
    assert len(row) == len(rows) and row[7].class_id == row[0].class_id == 0 and row[7].n_matches is None
    codes = {k: audio.fingerprint(audio.melody(v)) for k, v, _ in rows if k != 7}
    want = set()
    for q in (0, 20, 40, 60, 100):
        for k in codes:
            for o in range(-len(codes[k]), len(codes[q]) + 1) if k != q else ():
                e, n = audio.bit_errors(codes[q], codes[k], o)
                if e <= audio.MAX_BIT_ERROR and n >= audio.LEAST_OVERLAP:
                    want.add((q, k, o, round(e, 6)))
    assert {(r.vec_id, r.match_id, r.match_offset, r.bit_error) for r in got if r.match_id is not None} == want
    assert len(got) == len(row) + len(want) and len({(q, k) for q, k, _, _ in want if q == 0}) > 1
    for q in (0, 20, 40, 60, 100):
        assert row[q].n_matches == len({k for w, k, _, _ in want if w == q})
    clash = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumnsRenamed({"label": "codes"}).selectExpr("*", "1 AS key", "2 AS id", "3 AS query", "4 AS audio")
    for name, df in (("clash", clash), ("empty", clash.limit(0))):
        df.write.parquet(str(tmp_path / name / "embeddings.parquet"))
        assert audio.op1_audio(spark, str(tmp_path / name)).count() == (len(got) if name == "clash" else 0)


def slow_fingerprint(samples):
    """Codes by plain sums: each frame's spectrum line by line, each filter's rectangles number by number, bits one by one."""
    image = []
    for at in range(0, len(samples) - audio.FRAME + 1, audio.HOP):
        frame = samples[at : at + audio.FRAME].astype(float) / 32768 * np.hamming(audio.FRAME)
        power, classes = np.abs(np.fft.rfft(frame)) ** 2, [0.0] * 12
        for line in range(1, audio.FRAME // 2 + 1):
            hz = line * audio.RATE / audio.FRAME
            if audio.LOW <= hz < audio.HIGH:
                classes[round(12 * np.log2(hz / 440)) % 12] += power[line]
        size = sum(c * c for c in classes) ** 0.5
        image.append([c / size for c in classes] if size > 1e-3 else [0.0] * 12)

    def box(t0, t1, p0, p1):
        return sum(image[t][p] for t in range(t0, t1) for p in range(p0, p1))

    out = []
    for t in range(len(image) - audio.SPAN + 1):
        bits = ""
        for kind, low, height, width in audio.FILTERS:
            high, half, middle, whole = low + height, width // 2, low + max(1, height // 2), box(t, t + width, low, low + height)
            if kind == 0:
                a, b = whole, box(t, t + width, 0, low) + box(t, t + width, high, 12)
            elif kind == 1:
                a, b = box(t, t + half, low, high), box(t + half, t + width, low, high)
            elif kind == 2:
                a, b = box(t, t + width, low, middle), box(t, t + width, middle, high)
            elif kind == 3:
                a = box(t, t + half, low, middle) + box(t + half, t + width, middle, high)
                b = box(t, t + half, middle, high) + box(t + half, t + width, low, middle)
            elif kind == 4:
                a = box(t + width // 4, t + 3 * width // 4, low, high)
                b = whole - a
            else:
                a = box(t, t + width, low + height // 3, high - height // 3)
                b = whole - a
            v = np.log((1 + a) / (1 + b))
            bits += ["00", "01", "11", "10"][sum(v > edge for edge in (-0.35, 0.0, 0.35))]
        out.append(int(bits, 2))
    return out


def test_codes_are_those_of_plain_sums():
    rng = np.random.default_rng(6)
    same = total = 0
    for n in (20, 28, 40):
        for samples in (audio.melody(rng.standard_normal(n).tolist()), np.clip(rng.normal(0, 4000, audio.FRAME + audio.HOP * n), -32768, 32767).astype(np.int16)):
            got, want = audio.fingerprint(samples).tolist(), slow_fingerprint(samples)
            assert len(got) == len(want) > 0
            total += 32 * len(got)
            same += sum(32 - (a ^ b).bit_count() for a, b in zip(got, want, strict=True))
    assert same >= total - 2  # a value on an edge may be rounded to either side


def test_audio_search_is_brute_force_on_bit_errors(spark):
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 1 << 32, n, np.uint32) for n in (46, 46, 13, 120, 31, 12, 11)]
    codes = dict(enumerate(base))
    flips = lambda n, share: np.packbits(rng.random((n, 32)) < share, axis=1).view(">u4").ravel().astype(np.uint32)
    for i in range(12):  # noisy stretches of the long ones: few whole codes survive
        a = base[i % 4]
        start = int(rng.integers(0, max(1, len(a) - 20)))
        part = a[start:]
        codes[10 + i] = np.concatenate((rng.integers(0, 1 << 32, i % 3, np.uint32), part ^ flips(len(part), 0.1 + 0.01 * (i % 5))))
    codes[30] = np.tile(base[0][:4], 12)  # matches itself, moved, at several offsets
    codes[31] = np.tile(base[0][:4], 9)
    want = {}
    for q, a in codes.items():
        for k, b in codes.items():
            for o in range(-len(b), len(a) + 1) if q != k else ():
                e, n = audio.bit_errors(a, b, o)
                if e <= audio.MAX_BIT_ERROR and n >= audio.LEAST_OVERLAP:
                    want[q, k, o] = e
    df = spark.createDataFrame([(k, c.tobytes()) for k, c in codes.items()], "id long, codes binary")
    got = {(r.query, r.id, r.offset): r.bit_error for r in audio.matches(df, df).collect()}
    assert got == want
    assert len({o for q, k, o in got if (q, k) == (30, 31)}) > 1


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>one <svg/> two</p><p>three</p>", "one two three"),
        ("<p>one <svg class=x /> two <svg><title>a</title><text>drawn</text></svg> three</p>", "one two a drawn three"),
        ("<p>one <math/> two</p><p>three</p>", "one two three"),
        ("<p>with <math><mi>x</mi><mo>=</mo><mn>2</mn></math> given</p>", "with x=2 given"),
        ("<p>one</p><object data=a><p>two</p><p>three</p>", "one two three"),
        ("<p>one <object>else</object> two</p>", "one else two"),
        ("<p>one</p><select><option>a<p>two</p><p>three</p><select><option>no</select><p>four</p>", "one a two three four"),
        ("<p>one</p><svg><p>two</p><!-- </svg> --><p>three", "one two three"),
        ("<title>no</title><style>no</style><p>one</p><template><p>two</p></template><noscript><p>three</p></noscript><iframe>four</iframe>", "one two three four"),
        ("<article><p>E is <math><mi>mc</mi></math> ok</p><object>alt <p>text</p></object></article>", "E is mc ok alt text"),
        ("<p>one<textarea>no</textarea><script>'<p>no</p>'</script> two", "one two"),
        ("<p>one</p><svg>" + "<svg>" * 20_000 + "two", "one two"),
    ],
)
def test_html_keeps_text_beside_elements_left_out(page, text):
    assert " ".join(t for _, t, _ in html.blocks(page)) == text


@pytest.mark.parametrize(
    ("page", "found"),
    [
        ("<" + "a" * 1_000_000, 0),
        ("<aaaa" * 200_000, 0),
        ("x" + "<a \"'>" * 200_000, 1),
        ("<a '" * 100_000 + '">y' * 100_000, 1),
        ('<select "' * 100_000 + ">x", 1),
        ("<!--" * 200_000, 0),
        ("".join(f"<div>t{i} " for i in range(100_000)), 100_000),
        ("<p><td>" + "<h1>x" * 100_000, 100_000),
        ("<b>x" * 100_000, 1),
        ("<ul><li><p>x" * 50_000, 50_000),
    ],
)
def test_html_of_any_shape_takes_time_by_its_length(page, found):
    begun = time.process_time()
    got = html.blocks(page)
    assert len(got) == found
    if got:
        html.vectors(got, {"path": np.ones((html.PATHS, html.PATH_DIM), np.float32), "word": np.ones((html.WORDS, html.WORD_DIM), np.float32)})
    assert time.process_time() - begun < 10


def test_path_vectors_are_the_means_of_all_parts():
    rng = np.random.default_rng(8)
    weights = {"path": rng.standard_normal((html.PATHS, html.PATH_DIM)).astype(np.float32), "word": np.zeros((html.WORDS, html.WORD_DIM), np.float32)}
    for _ in range(30):
        found = html.blocks(html.training_page(rng)[0] + "plain")
        for (node, _, _), got in zip(found, html.vectors(found, weights), strict=True):
            parts = []
            while node is not None:
                parts += [zlib.crc32(w.encode()) % html.PATHS for w in node.part.split()] if not node.part.startswith(("html", "body")) else []
                node = node.parent
            assert np.allclose(got[: html.PATH_DIM], np.mean([weights["path"][i] for i in parts or [0]], axis=0), atol=1e-5)


@pytest.mark.parametrize("value", ["03/25/2021", "3/25/2021", "3/5/2021", "03-25-2021", "25-03-2021", "2021/03/25", "2021.03.25", "2021/3/5", "2021-25-03", "31.12.1999", "2024-02-29", "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00", "BE68 5390 0754 7034", "NO93 8601 1117 947"])
def test_usual_spellings_get_pseudonyms(value):
    kind = "iban" if value[0].isalpha() else "date"
    for text in (value, f"on {value}, or", f"X {value} AND MORE"):
        new, found = pii.mask_text(text)
        assert found == {kind: 1} and value not in new
        assert pii.mask_text(new, back=True)[0] == text
        assert "".join("9" if c.isdigit() else c for c in new.replace(value, "")) != "" and len(new) == len(text)
        assert [c for c in new if not c.isalnum()] == [c for c in text if not c.isalnum()]


def test_dates_in_all_orders_are_one_value():
    year, month, day = (int(x) for x in pii.mask_text("2021-03-25")[0].split("-"))
    assert pii.mask_text("03/25/2021")[0] == f"{month:02}/{day:02}/{year}" and pii.mask_text("25.03.2021")[0] == f"{day:02}.{month:02}.{year}"
    assert pii.mask_text("2021.03.25")[0] == f"{year}.{month:02}.{day:02}"
    days = [f"{m:02}/{d:02}/2021" for m in range(1, 13) for d in range(13, 29)]
    new = [pii.mask_text(v)[0] for v in days]
    assert len(set(new)) == len(days) and all(pii.mask_text(n, back=True)[0] == v for n, v in zip(new, days, strict=True))
    plain, grouped = pii.mask_text("GB82WEST12345698765432")[0], pii.mask_text("GB82 WEST 1234 5698 7654 32")[0]
    assert grouped.replace(" ", "") == plain
