"""Operators on small literal cases, and against plain code where SQL can't say the same."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from snapweave.functions import text as T
from snapweave.operators import activity, content, detect, graph, listing, rules, snapshots, text, transfer
from snapweave.sources import folder
from snapweave.streaming import feeds


def decided(spark, ignore, paths):
    rows = rules.decide(spark.createDataFrame([(p,) for p in paths], "path string"), ignore).collect()
    return {r.path: r.excluded for r in rows}


def test_rules(spark):
    ignore = "*.pfx\nbuild/\n/custom.py\ndocs/*.md\n!docs/keep.md\n[Ll]ibrary/\n**/cache/tmp\n*.o\n!important.o\nbin\n/out/\nthirdparty/**/test?.c\n*~\n# note\n\\#real\n"
    paths = {
        "a/key.pfx": True, "build/x.c": True, "src/build/y.c": True, "src/build": False, "custom.py": True, "src/custom.py": False, "docs/a.md": True, "docs/keep.md": False,
        "docs/deep/a.md": False, "Library/x": True, "library/x": True, "x/cache/tmp": True, "m.o": True, "important.o": False, "bin/run": True, "out/a": True, "src/out/a": False,
        "thirdparty/z/test1.c": True, "thirdparty/test12.c": False, "a~": True, "#real": True, "# note": False,
    }
    assert decided(spark, ignore, paths) == paths


def test_an_excluded_folder_settles_what_lies_below(spark):
    assert decided(spark, "work/\n!work/keep.txt\n.env\n.env.*\n!.env.example", ["work/keep.txt", ".env", ".env.local", ".env.example"]) == {"work/keep.txt": True, ".env": True, ".env.local": True, ".env.example": False}
    assert decided(spark, "", ["a"]) == {"a": False}


def generated(n):
    x, out = 1, bytearray(n)
    for i in range(n):
        x = (x * 1103515245 + 12345) & 0xFFFFFFFF
        out[i] = x >> 24
    return bytes(out)


def test_cut_points():
    numbers = content.gear()
    assert [f"{x:08x}" for x in (*numbers[:4], numbers[-1])] == ["62cb61fe", "50e84d5f", "30f613ac", "b5ccf875", "8e9830b9"]
    data = generated(6 << 20)
    assert content.cuts(data, content.PROFILES["medium"])[:5] == [1313115, 1676525, 2786806, 3904857, 4992487]
    assert content.cuts(data, content.PROFILES["huge"])[0] == 2786806


def test_cut_points_against_a_plain_loop():
    rnd = random.Random(3)
    for profile in (content.Profile(40, 100, 300, 0x3F, 0xF), content.Profile(33, 33, 64, 0xFF, 0x3), content.Profile(64, 256, 1024, 0x1FF, 0x7F)):
        for n in (0, 1, 40, 41, 5000):
            data = bytes(rnd.choice([0, 1, rnd.randrange(256)]) for _ in range(n))
            assert content.cuts(data, profile) == plain_cuts(data, profile)


def test_profiles(spark):
    sizes = [0, 8388607, 8388608, 134217727, 134217728, 2147483647, 2147483648]
    rows = spark.createDataFrame([(s,) for s in sizes], "size long").select("size", content.profile_of(F.col("size")).alias("p")).orderBy("size").collect()
    assert [r.p for r in rows] == [None, None, "medium", "medium", "large", "large", "huge"]


def test_slices_and_damage(spark):
    packs = spark.createDataFrame([("p", bytearray(b"hello\nworld"))], "pack string, content binary")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    members = spark.createDataFrame([("a", "p", 0, 6, sha(b"hello\n")), ("b", "p", 6, 5, sha(b"other"))], "path string, pack string, offset long, length long, sha256 string")
    got = {r.path: (bytes(r.raw), r.whole) for r in content.slices(members, packs).collect()}
    assert got == {"a": (b"hello\n", True), "b": (b"world", False)}


@pytest.mark.parametrize("seed", range(3))
def test_diffs(spark, seed):
    rnd = random.Random(seed)
    make = lambda: "".join(rnd.choice("abc") + rnd.choice(["\n", "\n", "\r\n"]) for _ in range(rnd.randint(0, 12)))
    pairs = [(str(i), make(), make()) for i in range(40)]
    rows = text.line_diff(spark.createDataFrame(pairs, "path string, before string, after string")).orderBy("path", "position").collect()
    for path, a, b in pairs:
        own = [r for r in rows if r.path == path]
        assert [r.text for r in own if r.side != "+"] == text.lines_of(a) and [r.text for r in own if r.side != "-"] == text.lines_of(b)
        x, y = text.lines_of(a), text.lines_of(b)
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                table[i + 1][j + 1] = table[i][j] + 1 if x[i] == y[j] else max(table[i][j + 1], table[i + 1][j])
        assert sum(r.side == " " for r in own) == table[-1][-1]


def test_merges():
    assert text.merge_text("a\nb\nc\n", "a\nB\nc\n", "a\nb\nC!\n")[1] == 1  # neighbouring lines
    assert text.merge_text("a\nb\nc\nd\n", "A\nb\nc\nd\n", "a\nb\nc\nD\n") == ("A\nb\nc\nD\n", 0)
    assert text.merge_text("a\n", "b\n", "b\n") == ("b\n", 0)
    assert text.merge_text("a\r\nb\r\n", "x\r\nb\r\n", "y\r\nb\r\n")[0] == "<<<<<<< ours\r\nx\r\n=======\r\ny\r\n>>>>>>> theirs\r\nb\r\n"
    assert text.merge_text("a", "b", "c") == ("<<<<<<< ours\nb\n=======\nc\n>>>>>>> theirs\n", 1)
    assert text.merge_text("", "", "x\n") == ("x\n", 0)
    rnd = random.Random(1)
    for _ in range(300):
        base = [rnd.choice("abcdef") + "\n" for _ in range(rnd.randint(0, 8))]
        edit = list(base)
        if edit:
            edit[rnd.randrange(len(edit))] = "Z\n"
        b, e = "".join(base), "".join(edit)
        assert text.merge_text(b, e, b) == (e, 0) == text.merge_text(b, b, e) and text.merge_text(b, e, e) == (e, 0)


def tree(spark, rows):
    return spark.createDataFrame([(p, len(s), s, x) for p, s, x in rows], "path string, size long, sha256 string, executable boolean")


def test_publication_rows(spark):
    """The eight cases of base, received, disk and head."""
    cases = {"R1": "AAAB", "R2": "AACB", "R3": "AA-B", "R4": "---B", "R5": "--CB", "R6": "AAA-", "R7": "AAC-", "R8": "AA--"}
    sides = [tree(spark, [(k, v[i], False) for k, v in cases.items() if v[i] != "-"]) for i in range(4)]
    got = {r.path: r.outcome for r in snapshots.publication(*sides).collect()}
    assert got == {"R1": "keep-head", "R2": "conflict", "R3": "keep-head", "R4": "keep-head", "R5": "conflict", "R6": "stays-deleted", "R7": "conflict", "R8": "stays-deleted"}


def test_merge_modes(spark):
    base, ours, theirs = tree(spark, [("a", "x", False), ("b", "x", False)]), tree(spark, [("a", "y", True), ("b", "x", True)]), tree(spark, [("a", "y", False)])
    got = {r.path: (r.decision, r.executable) for r in snapshots.merged(base, ours, theirs).collect()}
    assert got == {"a": ("exec-bit", True), "b": ("deleted-there", True)}


def test_graphs(spark):
    diamonds = [(f"n{3 * i + k}", f"n{3 * i + j}", n) for i in range(6) for k, j, n in ((1, 0, 0), (2, 0, 0), (3, 1, 0), (3, 2, 1))]
    edges = spark.createDataFrame([*diamonds, ("x", "gone", 0)], "child string, parent string, nth int")
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert graph.ancestors(edges, one("n18")).count() == 19
    assert graph.merge_base(edges, one("n4"), one("n5")).first().id == "n3"
    assert graph.route(edges, one("n18"), one("n0")).count() == 13
    levels = {r.id: r.level for r in graph.levels(edges, one("x", *(f"n{i}" for i in range(19)))).collect()}
    assert levels["x"] == 0 and levels["n18"] == 12
    pairs = spark.createDataFrame([("n0", "n18"), ("n18", "n0"), ("n4", "n5"), ("x", "n1"), ("x", "x")], "a string, b string")
    assert [r.relation for r in graph.relation(edges, pairs).orderBy("a", "b").collect()] == ["fast-forward", "behind", "diverged", "unrelated", "up-to-date"]


def test_sections(spark):
    rows = [("g", f"{i:02}", s) for i, s in enumerate([5, 5, 20, 3, 3, 3, 3, 3])]
    got = transfer.sections(spark.createDataFrame(rows, "g string, path string, size long"), "g", "path", 10, 3).orderBy("path").collect()
    assert [r.section for r in got] == [0, 0, 1, 2, 2, 2, 3, 3]


def test_detection(spark):
    key = "-----BEGIN PRIVATE KEY-----\nx\n-----END PRIVATE KEY-----"
    rows = spark.createDataFrame([("c.pem", "-----BEGIN CERTIFICATE-----\nx\n-----END CERTIFICATE-----"), ("k.pem", key), ("a/.env.local", "x"), ("n.txt", "a\x00b"), ("m", "<<<<<<< a\n")], "path string, text string")
    got = {r.path: r for r in rows.select("path", detect.only_certificates("text").alias("cert"), detect.credential_path("path").alias("cred"), detect.looks_binary("text").alias("bin"), detect.conflict_markers("text").alias("mark")).collect()}
    assert [got[p].cert for p in ("c.pem", "k.pem")] == [True, False] and got["a/.env.local"].cred and not got["m"].cred
    assert got["n.txt"].bin and got["m"].mark and not got["c.pem"].mark


def test_text_functions(spark):
    row = spark.createDataFrame([("  Hello, World!! ", 1536, '=a"b')], "n string, s long, c string")
    got = row.select(T.slug(F.col("n")), T.bytes_shown(F.col("s")), T.guarded(F.col("c")), T.smaller_percent(F.lit(3), F.lit(1))).first()
    assert tuple(got) == ("hello-world", "1.5 KB", "\"'=a\"\"b\"", 67)


def test_folders_and_stores(spark, tmp_path):
    for name, body in (("a/x.txt", "hi"), ("a/.git/y", "no"), ("a/rules.ignore", "*.log\n"), ("z", "")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    got = {r.path: (r.size, r.sha256) for r in folder.entries(spark, str(tmp_path)).collect()}
    assert got["a/x.txt"] == (2, hashlib.sha256(b"hi").hexdigest()) and set(got) == {"a/x.txt", "a/rules.ignore"}  # nor is the empty file
    assert folder.rule_files(spark, str(tmp_path)) == {"a": "*.log\n"}
    objects = spark.createDataFrame([("ab12", bytearray(b"x")), ("ab12", bytearray(b"x")), ("cd34", bytearray(b"y"))], "name string, raw binary")
    for _ in range(2):
        folder.put(objects, str(tmp_path / "store"))
    assert sorted(r.name for r in folder.get(spark, str(tmp_path / "store")).collect()) == ["ab12", "cd34"]


def plain_cuts(data, profile):
    """Ends of chunks by the rolling hash, byte after byte."""
    numbers = [int(x) for x in content.gear()]
    out, start, h = [], 0, 0
    for i, byte in enumerate(data):
        h = ((h << 1) + numbers[byte]) & 0xFFFFFFFF
        size = i - start + 1
        if size >= profile.least and (size >= profile.most or not h & (profile.strict if size < profile.target else profile.loose)):
            out.append(i + 1)
            start, h = i + 1, 0
    return out if not data or out and out[-1] == len(data) else [*out, len(data)]


TINY = content.Profile(40, 100, 300, 0x3F, 0xF)


def contents_of(seed, n=25):
    rnd = random.Random(seed)
    blocks = [bytes(rnd.choice(b"abcdef\n") for _ in range(rnd.randint(50, 400))) for _ in range(6)]
    return [(f"f{i:02}", bytearray(b"".join(rnd.choice(blocks) for _ in range(rnd.randint(0, 6))))) for i in range(n)]


def layout_of(rows):
    out = {}
    for path, data in rows:
        ends = plain_cuts(bytes(data), TINY)
        out[path] = [(a, bytes(data[a:b])) for a, b in zip([0, *ends], ends)]
    return out


def test_stored_files_and_reuse(spark):
    """Chunk accounting, entries, objects and what is still to be sent, beside plain loops."""
    rows, sha = contents_of(1), lambda b: hashlib.sha256(b).hexdigest()
    files = spark.createDataFrame(rows, "path string, content binary").repartition(3)
    layout = layout_of(rows)
    every = [raw for chunks in layout.values() for _, raw in chunks]
    got = content.dedup_statistics(content.chunks(files, TINY)).first()
    assert tuple(got) == (len(every), len(set(every)), sum(map(len, every)), sum(map(len, set(every))), sum(map(len, every)) - sum(map(len, set(every))))
    entries, objects = content.stored(files, TINY, 500)
    wanted = {p: [sha(bytes(d))] if len(d) < 500 else [sha(raw) for _, raw in layout[p]] for p, d in rows}
    assert {r.path: r.objects for r in entries.collect()} == wanted
    assert sorted(r.name for r in objects.collect()) == sorted({n for names in wanted.values() for n in names})
    held = {sha(raw) for raw in every[::3]}
    seen, expected = set(held), {}
    for path in sorted(layout):
        missing = 0
        for _, raw in layout[path]:
            if sha(raw) not in seen:
                seen.add(sha(raw))
                missing += 1
        if layout[path]:
            expected[path] = (len(layout[path]), missing)
    found = content.pieces_to_send(content.chunks(files, TINY), spark.createDataFrame([(h,) for h in held], "sha256 string")).collect()
    assert {r.path: (r.chunks, r.missing) for r in found} == expected


def test_deltas(spark):
    """A delta's steps give the target with its base, and are as large as a plain count says."""
    base, target = contents_of(2), contents_of(3)
    target = [(p, b[:100] + t + b[100:]) for (p, b), (_, t) in zip(base, target)]
    files = [spark.createDataFrame(rows, "path string, content binary") for rows in (base, target)]
    steps = content.delta_steps(*(content.chunks(f, TINY) for f in files))
    back = {r.path: bytes(r.content) for r in content.applied(steps, files[0]).collect()}
    assert back == {p: bytes(t) for p, t in target if t}
    old, new = layout_of(base), layout_of(target)
    sizes = {p: sum(9 + (0 if raw in {r for _, r in old[p]} else len(raw)) for _, raw in chunks) for p, chunks in new.items() if chunks}
    assert {r.path: r.delta for r in content.delta_sizes(steps).collect()} == sizes
    policy = spark.createDataFrame([(10, 300, 1), (200, 300, 1), (100, 190, 0), (10, 300, 12)], "d long, w long, n int").select(content.kept_as(F.col("d"), F.col("w"), F.col("n")).alias("k")).collect()
    assert [r.k for r in policy] == ["delta", "whole", "whole", "whole"]


def test_limits_of_comparisons(spark, monkeypatch):
    """Too large a diff is said to be, too large a merge is one conflict, and each has a limit of its own."""
    pairs = spark.createDataFrame([("p", "a\nb\nc", "x\ny\nz"), ("q", "a\nb", "a\nc"), ("r", "", "x")], "path string, before string, after string")
    monkeypatch.setattr(text.common, "__defaults__", (15,))
    assert text._diff(["a", "b", "c"], ["x", "y", "z"]) is None and text._diff(["a", "b"], ["a", "c"]) is not None
    monkeypatch.setattr(text, "MERGE_CELLS", 15)
    assert text.merge_text("a\nb\nc\n", "x\ny\nz\n", "a\nb\nc\n") == (None, 1)
    monkeypatch.setattr(text, "MERGE_CELLS", 16)
    assert text.merge_text("a\nb\nc\n", "x\ny\nz\n", "a\nb\nc\n") == ("x\ny\nz\n", 0)
    got = {r.path: (r.text, r.regions) for r in text.draft(pairs, ("one", "two")).collect()}
    assert got["q"] == ("a\n<<<<<<< one\nb\n=======\nc\n>>>>>>> two", 1) and got["r"] == ("<<<<<<< one\n=======\nx\n>>>>>>> two", 1)
    assert text.CELLS == 4_000_000


def test_merges_against_plain_settling():
    """Line ends by presence, and regions between lines that both sides kept."""
    assert text.merge_text("a\nb\n", "x\nb\r\n", "y\nb\n")[0].startswith("<<<<<<< ours\r\n")
    rnd = random.Random(9)
    for _ in range(200):
        base = [rnd.choice("abcd") + "\n" for _ in range(rnd.randint(0, 7))]
        sides = []
        for _ in range(2):
            edit = list(base)
            for _ in range(rnd.randint(0, 2)):
                at = rnd.randint(0, len(edit))
                edit[at : at + rnd.randint(0, 1)] = [rnd.choice("XYZ") + "\n"] * rnd.randint(0, 2)
            sides.append(edit)
        merged, conflicts = text.merge_text("".join(base), *("".join(x) for x in sides))
        for keep, side in ((0, sides[0]), (1, sides[1])):
            if sides[1 - keep] == base:
                assert (merged, conflicts) == ("".join(side), 0)
        assert conflicts == merged.count("=======\n") == merged.count("<<<<<<< ours\n")


def test_rule_text_algebra(spark):
    """Lines that say the opposite go, headings with nothing under them too, and one blank line beside them."""
    body = "# Always\n!output/\n\n# Mine\n/output\n*.log\n\n# Last\n!/output\r"
    docs = spark.createDataFrame([(1, body), (2, "# only\n!output"), (3, "a\n\n# x\n!output/\n\nb"), (4, "keep\n"), (5, "\n!output\n*.o")], "id int, text string")
    lines = listing.rule_lines(docs, "id")

    def left(rule):
        rows = listing.without_opposites(lines, rule, "id").collect()
        return {i: "\n".join(r.text for r in sorted((r for r in rows if r.id == i), key=lambda r: r.number)) for i in range(1, 6)}

    assert left("output/") == {1: "# Mine\n/output\n*.log", 2: "", 3: "a\n\nb", 4: "keep\n", 5: "\n*.o"}
    assert left("!output/")[1] == body.replace("/output\n*.log", "*.log")
    got = {(r.id, r.rule) for r in listing.missing_rules(lines, "# r\noutput/\n*.log\n!x", "id").collect()}
    assert got == {(1, "!x"), (2, "*.log"), (2, "!x"), (3, "*.log"), (3, "!x"), (4, "output/"), (4, "*.log"), (4, "!x"), (5, "*.log"), (5, "!x")}


def test_package_starters(spark):
    rows = [("app/web", "package.json", '{"scripts": {"lint": "x", "test": "y"}}'), ("app/web", "pnpm-lock.yaml", ""), ("site/web", "package.json", '{"scripts": {"build": "x"}}'), ("n", "package.json", '{"scripts": {"test": "echo no test specified"}}'), ("n", "go.mod", ""), ("bad", "package.json", "{"), ("py", "requirements.txt", ""), ("py", "pyproject.toml", "")]
    got = {r.directory: (r.recipe, r.command, r.because) for r in listing.starters(spark.createDataFrame(rows, "directory string, name string, text string")).collect()}
    assert got == {
        "app/web": ("app-web-check", "corepack enable && pnpm install --frozen-lockfile && pnpm run lint && pnpm run test", "package.json scripts: lint, test"),
        "site/web": ("site-web-check", "npm install && npm run build", "package.json scripts: build"),
        "n": ("n-check", "go vet ./... && go test ./...", "go.mod"),
        "py": ("py-check", "python -m pip install -r requirements.txt && python -m pytest", "pyproject.toml"),
    }


def test_layers_through_folders_and_tracked_files(spark):
    layers = {"": "out/\n*.log", "out": "!*.md", "src": "!*.log\ngen/"}
    paths = ["out/a.md", "src/x.log", "x.log", "src/gen/y", "src/z"]
    rows = listing.layered(spark.createDataFrame([(p,) for p in paths], "path string"), layers).collect()
    assert {r.path: (r.layer, r.excluded) for r in rows} == {"out/a.md": ("", True), "src/x.log": ("src", False), "x.log": ("", True), "src/gen/y": ("src", True), "src/z": (None, False)}
    tracked = spark.createDataFrame([("out/a.md",), ("x.log",)], "path string")
    rows = listing.layered(spark.createDataFrame([(p,) for p in paths], "path string"), layers, tracked).collect()
    assert {r.path for r in rows if r.excluded} == {"src/gen/y"}


def test_merge_base_in_search_order(spark):
    """Of two ancestors equally near the one behind the first parent is the base, whatever their names are."""
    edges = spark.createDataFrame([("l", "a", 0), ("l", "z", 1), ("r", "z", 0), ("r", "a", 1)], "child string, parent string, nth int")
    one = lambda i: spark.createDataFrame([(i,)], "id string")
    assert graph.merge_base(edges, one("l"), one("r")).first().id == "z" and graph.merge_base(edges, one("r"), one("l")).first().id == "a"
    assert graph.merge_base(edges, one("l"), one("gone")).collect() == []


def test_nearest_by_size(spark):
    rnd = random.Random(6)
    mine = [(f"{rnd.choice('ab')}/{i}{rnd.choice(['.x', '.Y', ''])}", rnd.randint(0, 60)) for i in range(80)]
    others = [(f"{rnd.choice('ab')}/{i + 40}{rnd.choice(['.x', '.y', ''])}", rnd.randint(0, 60)) for i in range(80)]
    kind = lambda p: (p.split("/")[0], re.search(r"[^/](\.[^./]*)?$", p)[1] and re.search(r"(\.[^./]*)$", p)[1].lower())
    wanted = {}
    for p, n in set(mine):
        best = min(((abs(n - m), q) for q, m in others if q != p and kind(q) == kind(p) and m <= 2 * n and n <= 2 * m), default=None)
        if best:
            wanted[p] = best[1]
    got = transfer.nearest(spark.createDataFrame(mine, "path string, size long"), spark.createDataFrame(others, "path string, size long")).collect()
    assert {r.path: r.base for r in got} == wanted


def test_batches_and_windows(spark):
    rows = [("g", f"{i:02}", s, j) for i, (s, j) in enumerate([(5, 1), (5, 1), (1, 9), (1, 2), (50, 1), (1, 1)])]
    got = transfer.put_batches(spark.createDataFrame(rows, "g string, path string, size long, json long"), "g", "path", 3, 10, 10).orderBy("path").collect()
    assert [r.batch for r in got] == [0, 0, 1, 2, 3, 4]
    sizes = spark.createDataFrame([(1,), (3 << 20,)], "size long").select(listing.sample_windows(F.col("size")).alias("w")).collect()
    assert sizes[0].w is None and [(x["at"], x["size"]) for x in sizes[1].w] == [(0, 262144), (3 << 19, 262144)]
    kept = [True] * 16 + [False] * 13 + [True] * 3 + [True] * 40
    chunks = spark.createDataFrame([("f", i, k) for i, k in enumerate(kept)] + [("g", i, False) for i in range(15)], "path string, position int, kept boolean")
    assert {r.path: (r.tried, r.allowed) for r in listing.compression_verdicts(chunks).collect()} == {"f": (32, False), "g": (15, True)}


def test_output_lines_are_bounded(spark, tmp_path):
    parts = [(1, 0, "ab", False), (1, 1, "c\rde", False), (1, 2, "fghijk", False), (1, 3, "lm\nno", True), (2, 0, "x" * 9 + "\n\n", True), (3, 0, None, True)]
    spark.createDataFrame(parts, "stream long, seq long, chunk string, last boolean").write.parquet(str(tmp_path / "parts"))
    stream = spark.readStream.schema("stream long, seq long, chunk string, last boolean").parquet(str(tmp_path / "parts"))
    rows = feeds.run_to_end(feeds.output_lines(stream, most=6)).orderBy("stream", "number").collect()
    note = feeds.OMITTED
    assert [(r.stream, r.number, r.line, r.ending) for r in rows] == [(1, 0, "abc", "\r"), (1, 1, note, "\n"), (1, 2, "no", ""), (2, 0, note, "\n"), (2, 1, "", "\n")]


def test_chunks_of_files_that_arrive_in_looks(spark, monkeypatch):
    """Parts that come over two looks, in any order within each, make the chunks of the whole file; lots are few, so keys share them."""
    monkeypatch.setattr(feeds, "LOTS", 3)
    monkeypatch.setattr(feeds, "PARTS", 2)
    files = [(p, bytes(d)) for p, d in contents_of(4)]
    parts = [(p, i, d[i * 90 : i * 90 + 90], (i + 1) * 90 >= len(d)) for p, d in files for i in range(max(1, -(-len(d) // 90)))]
    random.Random(5).shuffle(parts)
    half = {p: len(d) // 180 for p, d in files}
    looks = [spark.createDataFrame([r for r in parts if (r[1] < half[r[0]]) == first], "path string, seq long, data binary, last boolean") for first in (True, False)]
    found = feeds.run_looks(looks, lambda rows: feeds.streamed_chunks(rows, TINY))
    wanted = [(p, n, hashlib.sha256(raw).hexdigest()) for p, rows in layout_of(files).items() for n, (_, raw) in enumerate(rows)]
    assert sorted((r.path, r.position, r.sha256) for r in found.collect()) == sorted(wanted)


def test_fresh_saves_of_keys_that_share_lots(spark, monkeypatch):
    """Lots are groups, not keys: a feed of many keys calls its function once a lot, and each key has its own state."""
    monkeypatch.setattr(feeds, "LOTS", 2)
    first, second = [(p, s) for p in range(40) for s in (1, p % 7)], [(p, s) for p in range(20, 60) for s in (3, 3, 5, 0)]
    looks = [spark.createDataFrame(rows, "project long, sequence long") for rows in ([*first, (None, 1)], second, [(59, 6), (None, 9)])]
    found = sorted(map(tuple, feeds.run_looks(looks, feeds.fresh_saves).collect()))
    assert found == sorted([(p, s) for p in range(20, 40) for s in (3, 5) if s > max(1, p % 7)] + [(59, 6)])
    plan = feeds.fresh_saves(spark.readStream.format("rate").load().selectExpr("value AS project", "value AS sequence"))
    assert "lot" in plan._jdf.queryExecution().analyzed().toString()


def test_licences_of_a_large_catalogue(spark):
    """The first marker that a text holds, also across words' borders and without inner words; a text is flattened once, not once a marker."""
    rnd = random.Random(9)
    words = ["a", "of", "the", "licence", "grants", "use", "é", "code,"]
    sentence = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    markers = {f"m{i}": m for i, m in enumerate(dict.fromkeys([*(sentence(rnd.randint(3, 5)) for _ in range(40)), "use code,", "grantsé", "e a o"]))}
    texts = [(i, sentence(rnd.randint(0, 9)).replace(" ", rnd.choice([" ", "\n", "  "])).upper()) for i in range(300)] + [(300, "xgrantsÉx"), (301, None), (302, "licencE A  of")]
    got = detect.licence_of(spark.createDataFrame(texts, "id int, text string"), markers)
    flat = lambda t: re.sub(r"[ \n]+", " ", t).strip(" ").lower()
    wanted = {i: next((n for n, m in markers.items() if m in flat(t)), None) if t is not None else None for i, t in texts}
    assert {r.id: r.licence for r in got.collect()} == wanted and len(set(wanted.values())) > 10
    assert [r.licence for r in detect.licence_of(spark.createDataFrame([("x",)], "text string"), {}).collect()] == [None]
    assert got.where("licence is not null")._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 2


def test_folder_walk_rules_and_survey(spark, tmp_path):
    folder.write_rules(spark, str(tmp_path), {"": "*.log\n", "src": "!keep.log\ngen/\n"})
    for name in ("a.log", "b.txt", "src/keep.log", "src/gen/x", "src/y"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    layers = folder.rule_files(spark, str(tmp_path))
    assert layers == {"": "*.log\n", "src": "!keep.log\ngen/\n"}
    rows = folder.survey(spark, str(tmp_path), layers).collect()
    assert {r.path for r in rows} == {"b.txt", "src/keep.log", "src/y", "rules.ignore", "src/rules.ignore"}
    first, more = folder.walk(spark, str(tmp_path), 3)
    assert more and [r.path for r in first.collect()] == ["a.log", "b.txt", "rules.ignore"]
    assert not folder.walk(spark, str(tmp_path), 7)[1]


def test_publish_name_of_a_long_list(spark):
    """The name is that of the whole sorted list, however many lines and Arrow batches it takes."""
    rows = [(f"p{i % 7 if i % 3 else 0}", f"é{i}", f"{i * 7919 % 10007:x}") for i in range(25_000)]
    got = content.publish_name(spark.createDataFrame(rows, "project string, path string, sha256 string").repartition(5), "project", "h", "m").collect()
    lists = {}
    for project, path, sha in rows:
        lists.setdefault(project, []).append(f"{path}:{sha}".encode())
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert sorted(map(tuple, got)) == sorted((p, digest(f"{p}\nh\nm\n{digest(b'\n'.join(sorted(x)))}".encode())[:40]) for p, x in lists.items())


def test_csv_export(spark, tmp_path):
    rows = spark.createDataFrame([('=1"', "é")], "a string, b string")
    activity.write_csv(rows, str(tmp_path / "csv"))
    body = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert body == '\ufeff"a","b"\r\n"\'=1""","é"\r\n'.encode()


def test_times_without_zone(spark):
    rows = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00.123456' AS a UNION ALL SELECT timestamp_ntz'1969-12-31 23:59:59.5'").select(T.micros("a").alias("m")).collect()
    assert sorted(r.m for r in rows) == [-500_000, 1710037800123456]


def test_secret_forms():
    assert detect.secret_variants(("a b\n\"c", "")) == sorted({"a b\n\"c", "a%20b%0A%22c", 'a b\\n\\"c', "a b", "a%20b", '"c', "%22c", '\\"c'}, key=lambda v: (-len(v), v))


def test_nothing_outside_imports_llm():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "snapweave"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import) .*llm", path.read_text(), re.MULTILINE), path
