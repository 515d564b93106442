"""Listings of folders, versions and projects: layered rules, caches, differences, references and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapweave.functions.text import slug
from snapweave.operators.rules import layers_of, settled


def layered(paths: DataFrame, layers: dict[str, str], tracked: DataFrame | None = None) -> DataFrame:
    """paths (path) with layer and excluded, by nested rule files (folder to text; '' is the root) and tracked files (path)."""
    return settled(paths, layers_of(layers), tracked).drop("rule")


#: Milliseconds before the index was written in which a file may have changed without its time moving (fixed value).
RACY_MS = 2000


def cached(listing: DataFrame, index: DataFrame, written: float | None = None, store: bool = False) -> DataFrame:
    """(path, sha256): the index's digest where size and time of change are as it has them; null where the file must be read.

    A file that changed less than RACY_MS before the index was `written` is read again. With store, chunks must be known too,
    but for empty files.
    """
    known = index.select("path", F.col("size").alias("was"), F.col("mtime").alias("then"), "sha256", *(["chunks"] if store else []))
    hit = (F.col("size") == F.col("was")) & (F.col("mtime") == F.col("then"))
    if written is not None:
        hit = hit & (F.col("mtime") < written - RACY_MS)
    if store:
        hit = hit & ((F.size("chunks") > 0) | (F.col("size") == 0))
    return listing.select("path", "size", "mtime").join(known, "path", "left").select("path", F.when(hit, F.col("sha256")).alias("sha256"))


def changes_only(base: DataFrame, tree: DataFrame) -> DataFrame:
    """(path, sha256, removed): entries of tree that are new or other than base's, and those that base has besides."""
    entry = lambda t, name: t.select("path", F.struct("sha256", "executable").alias(name))
    rows = entry(base, "b").join(entry(tree, "t"), "path", "full_outer").where(~F.col("b").eqNullSafe(F.col("t")))
    return rows.select("path", F.col("t.sha256").alias("sha256"), F.col("t").isNull().alias("removed"))


def changed_rows(base: DataFrame, disk: DataFrame, deletions: bool, most: int) -> tuple[DataFrame, bool]:
    """(path, change, turn) of a folder against a baseline, spread over folders, and whether there are more than `most`. A report's limit.

    What disk lacks is a deletion only where the whole folder was looked at (`deletions`).
    """
    side = lambda t, name: t.select("path", F.struct("sha256").alias(name))
    rows = side(base, "b").join(side(disk, "d"), "path", "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("d").isNull(), "deleted" if deletions else None).when(F.col("b.sha256") != F.col("d.sha256"), "modified")
    found = rows.select("path", change.alias("change")).where("change is not null").select("*", F.regexp_extract("path", "^(.*)/", 1).alias("folder"))
    turn = F.row_number().over(Window.partitionBy("folder").orderBy("path"))
    spread = found.select("path", "change", turn.alias("turn"), "folder")
    kept = spread.orderBy("turn", "folder").limit(most + 1)
    cut_off = kept.count() > most
    return kept.orderBy("turn", "folder").limit(most).select("path", "change", "turn"), cut_off


def status(manifest: DataFrame, local: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, state): absent (in the manifest, not on disk), behind (the manifest moved on), edited (disk isn't what was received)."""
    side = lambda t, name: t.select("path", F.col("sha256").alias(name))
    rows = side(manifest, "m").join(side(local, "l"), "path", "full_outer").join(side(disk, "d"), "path", "full_outer")
    state = F.when(F.col("m").isNotNull() & F.col("d").isNull(), "absent").when(~F.col("m").eqNullSafe(F.col("l")) & F.col("d").eqNullSafe(F.col("l")), "behind").when(~F.col("d").eqNullSafe(F.col("l")), "edited")
    return rows.select("path", state.alias("state")).where("state is not null")


def released(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(path, verdict) of files against a release's entries: whole, size, digest, missing or unlisted."""
    rows = entries.select("path", F.struct("size", "sha256").alias("e")).join(files.select("path", F.struct("size", "sha256").alias("f")), "path", "full_outer")
    verdict = F.when(F.col("f").isNull(), "missing").when(F.col("e").isNull(), "unlisted").when(F.col("e.size") != F.col("f.size"), "size").when(F.col("e.sha256") != F.col("f.sha256"), "digest").otherwise("whole")
    return rows.select("path", verdict.alias("verdict"))


def by_prefix(objects: DataFrame, asked: DataFrame) -> DataFrame:
    """(prefix, matches, name) of asked (prefix, at least 4 characters): the one name that starts so; null if there are none or several.

    An equi-join on the first four characters, then the rest of the prefix.
    """
    names = objects.select("name").distinct().select("name", F.substring("name", 1, 4).alias("head"))
    rows = asked.where(F.char_length("prefix") >= 4).select("prefix", F.substring("prefix", 1, 4).alias("head"))
    hits = rows.join(names, "head", "left").select("prefix", F.when(F.col("name").startswith(F.col("prefix")), F.col("name")).alias("name"))
    found = hits.groupBy("prefix").agg(F.count("name").alias("matches"), F.min("name").alias("name"))
    return found.select("prefix", "matches", F.when(F.col("matches") == 1, F.col("name")).alias("name"))


def alike_projects(names: DataFrame, asked: DataFrame, most: int | None = None) -> DataFrame:
    """(slug, project, same): projects whose slug equals an asked one, or starts or is started by it word by word; the equal one first, `most` of each.

    Each slug is spread into its prefixes of whole words, so both directions are equi-joins.
    """
    spread = lambda t, own: t.select(F.col("slug").alias(own), F.split("slug", "-").alias("w")).select(own, F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda n: F.array_join(F.slice("w", 1, n), "-"))).alias("prefix"))
    whole = lambda t, own: t.select(F.col("slug").alias(own), F.col("slug").alias("prefix"))
    down = whole(asked, "slug").join(spread(names, "project"), "prefix")
    up = spread(asked, "slug").join(whole(names, "project"), "prefix")
    rows = down.select("slug", "project").unionByName(up.select("slug", "project")).distinct().select("*", (F.col("slug") == F.col("project")).alias("same"))
    if most is not None:
        rows = rows.select("*", F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("same"), "project")).alias("n")).where(F.col("n") <= most).drop("n")
    return rows


def paths_present(folder: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, paths, present): how many paths of each project (project, path) a folder (path) has."""
    here = folder.select("path").distinct().withColumn("here", F.lit(1))
    return projects.join(here, "path", "left").groupBy("project").agg(F.count("*").alias("paths"), F.count("here").alias("present"))


def largest(files: DataFrame, most: int) -> DataFrame:
    """(path, size, truncated): the greatest files, at most so many, and whether there are more. A report's limit."""
    top = files.select("path", "size").orderBy(F.desc("size"), "path").limit(most + 1)
    n = F.row_number().over(Window.orderBy(F.desc("size"), "path"))
    rows = top.select("*", n.alias("n"), F.count("*").over(Window.partitionBy()).alias("all"))
    return rows.where(F.col("n") <= most).select("path", "size", (F.col("all") > most).alias("truncated"))


def push_rank(ref: Column) -> Column:
    """HEAD, then main, master, other branches, and tags last."""
    return F.when(ref == "HEAD", 0).when(ref == "refs/heads/main", 1).when(ref == "refs/heads/master", 2).when(ref.startswith("refs/tags/"), 4).otherwise(3)


def marked(refs: DataFrame, marks: DataFrame) -> DataFrame:
    """refs (ref, target) with the mark of their target (mark, target), or why there is none."""
    return refs.join(marks, "target", "left").select("ref", "mark", F.when(F.col("mark").isNull(), "not exported").alias("problem"))


def nearest_command(asked: DataFrame, commands: tuple[str, ...]) -> DataFrame:
    """asked (word) with the command at the least edit distance, if that is at most a third of the longer name."""
    scored = [F.struct(F.levenshtein("word", F.lit(c)).alias("d"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(commands)]
    best = F.least(*scored) if len(scored) > 1 else scored[0]
    rows = asked.select("word", best.alias("b"))
    near = F.col("b.d") * 3 <= F.greatest(F.char_length("word"), F.char_length(F.col("b.c")))
    return rows.select("word", F.when(near, F.col("b.c")).alias("command"))


def paragraphs(lines: DataFrame, key: str = "path") -> DataFrame:
    """(key, paragraph, first, lines) of lines (key, number, text): runs of lines that aren't blank, numbered from 0."""
    w = Window.partitionBy(key).orderBy("number")
    blank = F.trim("text") == ""
    rows = lines.select(key, "number", blank.alias("blank"), F.sum(blank.cast("int")).over(w).alias("island")).where("not blank")
    runs = rows.groupBy(key, "island").agg(F.min("number").alias("first"), F.count("*").alias("lines"))
    return runs.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("first")) - 1).alias("paragraph"), "first", "lines")


def _root(*names: str) -> Column:
    """Whether one of these stands at a project's root."""
    return F.bool_or(F.lower("name").isin(*names))


def project_kinds(entries: DataFrame) -> DataFrame:
    """(project, kinds) of entries (project, name) at the root: at most one engine, then every language; builds only without an engine."""
    ends = lambda suffix: F.bool_or(F.endswith(F.lower("name"), F.lit(suffix)))
    tests = {
        "unity": _root("assets") & _root("projectsettings"), "unrealengine": ends(".uproject"), "godot": _root("project.godot"), "cocos": _root("project.json") & _root("assets"),
        "node": _root("package.json"), "python": _root("pyproject.toml", "requirements.txt", "setup.py"), "rust": _root("cargo.toml"), "go": _root("go.mod"), "gradle": _root("build.gradle", "build.gradle.kts"),
        "visualstudio": ends(".sln"), "objective-c": ends(".xcodeproj"), "cmake": _root("cmakelists.txt"),
    }
    engines, languages = ("unity", "unrealengine", "godot", "cocos"), ("node", "python", "rust", "go", "gradle")
    found = entries.groupBy("project").agg(*(t.alias(k) for k, t in tests.items()))
    engine = F.coalesce(*(F.when(F.col(f"`{k}`"), k) for k in engines))
    picked = F.array_compact(F.array(engine, *(F.when(F.col(k), k) for k in languages)))
    builds = F.when(F.size(picked) == 0, F.array_compact(F.array(*(F.when(F.col(f"`{k}`"), F.lit(k)) for k in ("visualstudio", "objective-c", "cmake"))))).otherwise(F.array().cast("array<string>"))
    return found.select("project", F.concat(picked, builds).alias("kinds"))


#: The line that ties a version to a commit (an input value of the service whose messages are read).
TRAILER = "Git-commit:"
MESSAGE_LIMIT = 240


def commit_of(message: Column, trailer: str = TRAILER) -> Column:
    """The commit that the last marker of a message names; null without one."""
    return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(message, F.lit(rf"\Q{trailer}\E\s*([0-9a-f]{{40}})\b"), F.lit(1))), -1)


def with_commit(message: Column, sha: Column, trailer: str = TRAILER, most: int = MESSAGE_LIMIT) -> Column:
    """A message with its marker, cut on a word where both are longer than `most`."""
    room = most - len(trailer) - 43
    body = F.regexp_replace(message, r"\s+$", "")
    kept = F.substring(body, 1, room - 1)
    tidy = F.regexp_replace(kept, r"\s+\S*$", "")
    short = F.regexp_replace(F.when(F.char_length(tidy) > room / 2, tidy).otherwise(kept), r"\s+$", "")
    short = F.concat(F.when(short == "", F.substring(sha, 1, 8)).otherwise(short), F.lit("…"))
    return F.concat(F.when(F.char_length(body) <= room, body).otherwise(short), F.lit(f"\n\n{trailer} "), sha)


def without_marker(message: Column, trailer: str = TRAILER) -> Column:
    """A message as a person wrote it: without marker lines, and no more than one blank line in a row."""
    bare = F.regexp_replace(message, rf"(?m)^\s*\Q{trailer}\E\s*[0-9a-f]{{40}}\s*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


#: Extensions whose content is compressed already (fixed values).
COMPRESSED = (
    ".7z", ".aac", ".avi", ".br", ".bz2", ".cbx", ".docx", ".flac", ".gif", ".gguf", ".gz", ".heic", ".jpeg", ".jpg", ".jxl", ".m4a", ".m4v", ".mkv",
    ".mov", ".mp3", ".mp4", ".odp", ".ods", ".odt", ".ogg", ".onnx", ".opus", ".pdf", ".png", ".pptx", ".rar", ".safetensors", ".webm", ".webp", ".xlsx",
    ".xz", ".zip", ".zst",
)
#: Media types by extension (fixed values).
MEDIA = {
    ".css": "text/css", ".csv": "text/csv", ".gif": "image/gif", ".html": "text/html", ".jpeg": "image/jpeg", ".jpg": "image/jpeg", ".js": "text/javascript",
    ".json": "application/json", ".md": "text/markdown", ".mjs": "text/javascript", ".pdf": "application/pdf", ".png": "image/png", ".py": "text/x-python",
    ".svg": "image/svg+xml", ".ts": "text/typescript", ".tsx": "text/typescript", ".txt": "text/plain", ".wasm": "application/wasm", ".webp": "image/webp",
    ".xml": "application/xml", ".yaml": "application/yaml", ".yml": "application/yaml", ".zip": "application/zip",
}
#: Least bytes worth compressing, bytes of a sample, sizes from which one is taken, the share that must be left, chunks of a review, and its rate (fixed values).
LEAST_BYTES, SAMPLE_BYTES, SAMPLED_FROM, WORTH, REVIEW, KEEP_RATE = 4096, 256 << 10, 8 * (256 << 10), 0.95, 16, 4


def compression(extension: Column, size: Column) -> Column:
    """How to try to compress a file: stored as it is, sampled first, or whole."""
    return F.when(extension.isin(*COMPRESSED) | (size < LEAST_BYTES), "store").when(size >= SAMPLED_FROM, "sample").otherwise("try")


def sample_windows(size: Column) -> Column:
    """Where a file is sampled: at its start and from its middle."""
    one = lambda at: F.struct(at.cast("long").alias("at"), F.lit(SAMPLE_BYTES).cast("long").alias("size"))
    return F.when(size >= SAMPLED_FROM, F.array(one(F.lit(0)), one(F.floor(size / 2))))


def worth_keeping(source: Column, compressed: Column) -> Column:
    return compressed < source * WORTH


def compression_verdicts(chunks: DataFrame, review: int = REVIEW, rate: int = KEEP_RATE) -> DataFrame:
    """(path, chunks, tried, allowed) of chunks (path, position, kept): a file isn't compressed further after the first whole window of
    `review` chunks of which fewer than one in `rate` were worth it. Windows are judged each on itself, so they are groups, not a fold."""
    windows = chunks.groupBy("path", F.floor(F.col("position") / review).alias("window")).agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"))
    bad = F.min(F.when((F.col("n") == review) & (F.col("kept") * rate < F.col("n")), F.col("window")))
    files = windows.groupBy("path").agg(F.sum("n").alias("chunks"), bad.alias("bad"))
    return files.select("path", "chunks", F.when(F.col("bad").isNull(), F.col("chunks")).otherwise((F.col("bad") + 1) * review).alias("tried"), F.col("bad").isNull().alias("allowed"))


def media_type(extension: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in MEDIA.items() for x in pair))
    return F.coalesce(F.try_element_at(table, extension), F.lit("application/octet-stream"))


# --- the text of rule files, a row for each line (key, number, text)


def rule_lines(texts: DataFrame, key: str) -> DataFrame:
    return texts.select(key, F.posexplode(F.split("text", "\n")).alias("number", "text"))


def _rule(text: Column) -> Column:
    """A line as a rule; null for comments and blank lines."""
    plain = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when((plain != "") & ~F.startswith(plain, F.lit("#")), plain)


def rule_target(rule: Column) -> Column:
    """What a rule is about, without ! and slashes at its ends."""
    return F.regexp_replace(F.regexp_replace(rule, "^!", ""), "^/+|/+$", "")


def missing_rules(lines: DataFrame, reference: str, key: str) -> DataFrame:
    """(key, place, rule) of the rules of a reference text: those that a rule file neither holds nor overrules by keeping what they name."""
    rules = [x for x in map(str.strip, reference.split("\n")) if x and not x.startswith("#")]
    own = lines.select(key, _rule(F.col("text")).alias("rule")).where("rule is not null").distinct()
    kept = own.where(F.startswith("rule", F.lit("!"))).select(key, rule_target(F.col("rule")).alias("target"), F.lit(1).alias("kept"))
    wanted = lines.select(key).distinct().select(key, F.posexplode(F.array(*map(F.lit, rules))).alias("place", "rule")).withColumn("target", rule_target(F.col("rule")))
    left = wanted.join(own.withColumn("held", F.lit(1)), [key, "rule"], "left").join(kept.distinct(), [key, "target"], "left")
    return left.where(F.col("held").isNull() & (F.startswith("rule", F.lit("!")) | F.col("kept").isNull())).select(key, "place", "rule")


def without_opposites(lines: DataFrame, rule: str, key: str) -> DataFrame:
    """(key, number, text): lines without those that say the opposite of a rule about the same thing, and without headings that are left with
    nothing under them (with a blank line beside them)."""
    keeping, target = rule.strip().startswith("!"), rule.strip().removeprefix("!").strip("/")
    w = Window.partitionBy(key).orderBy("number")
    plain = F.regexp_replace("text", r"^\s+|\s+$", "")
    rows = lines.select(key, "number", "text", (plain == "").alias("blank"), _rule(F.col("text")).alias("rule"))
    rows = rows.select("*", (F.col("rule").isNotNull() & (rule_target(F.col("rule")) == target) & (F.startswith("rule", F.lit("!")) != keeping)).alias("opposite"), F.sum(F.col("blank").cast("int")).over(w).alias("island"))
    block = Window.partitionBy(key, "island", "blank")
    gone = F.bool_or("opposite").over(block) & ~F.bool_or(F.col("rule").isNotNull() & ~F.col("opposite")).over(block)
    rows = rows.select("*", (gone & ~F.col("blank")).alias("empty"))
    # the blank line after an emptied paragraph goes, or the one before it where it is the last
    after = F.col("blank") & F.coalesce(F.lag("empty").over(w), F.lit(False))
    last = F.max("number").over(Window.partitionBy(key, "island"))
    rows = rows.select("*", after.alias("after"), last.alias("last"), F.max("number").over(Window.partitionBy(key)).alias("end"))
    before = F.col("blank") & F.coalesce(F.lead("empty").over(w), F.lit(False)) & (F.col("last") == F.col("end"))
    return rows.select("*", before.alias("before")).where("not (opposite or empty or after or before)").select(key, "number", "text")


def authored_by_starter(lines: DataFrame, marker: str, own: str, fingerprint: tuple[str, ...], key: str) -> DataFrame:
    """(key, authored): whether a rule file was written by a starter: its marker, or its own rule and three of its fingerprint."""
    rows = lines.select(key, "text", _rule(F.col("text")).alias("rule"))
    seen = F.size(F.array_intersect(F.collect_set(F.when(F.col("rule").isin(own, *fingerprint), F.col("rule"))), F.array(*map(F.lit, fingerprint))))
    return rows.groupBy(key).agg((F.bool_or(F.contains("text", F.lit(marker))) | (F.coalesce(F.bool_or(F.col("rule") == own), F.lit(False)) & (seen >= 3))).alias("authored"))


def took_side(conflicts: DataFrame, ours: DataFrame, theirs: DataFrame, side: str) -> DataFrame:
    """(path, sha256): conflicts (path) settled by one side's entry; null where that side has none, so the path goes."""
    chosen = (ours if side == "ours" else theirs).select("path", "sha256")
    return conflicts.select("path").join(chosen, "path", "left").select("path", "sha256")


def unpaired(chain: DataFrame, published: DataFrame) -> DataFrame:
    """(id, depth) of a chain (id, depth) up to, and without, its first published save."""
    stop = chain.join(published.select("id"), "id", "left_semi").agg(F.min("depth").alias("stop"))
    return chain.join(F.broadcast(stop), F.col("stop").isNull() | (F.col("depth") < F.col("stop"))).select("id", "depth")  # one row


def starters(entries: DataFrame) -> DataFrame:
    """(directory, recipe, command, because): a check for each package (directory, name, text of its manifests): its scripts, fastest first, or its language's own.

    A manifest that isn't JSON, or names none of the scripts, gives none, and the next language is asked. Recipes that would share a name take the whole directory's.
    """
    text = lambda name: F.max(F.when(F.col("name") == name, F.coalesce("text", F.lit(""))))
    has = lambda name: F.coalesce(F.bool_or(F.col("name") == name), F.lit(False))
    files = {"pnpm": "pnpm-lock.yaml", "yarn": "yarn.lock", "npm": "package-lock.json", "rust": "Cargo.toml", "go": "go.mod", "pyproject": "pyproject.toml", "requirements": "requirements.txt"}
    found = entries.groupBy("directory").agg(text("package.json").alias("manifest"), *(has(name).alias(k) for k, name in files.items()))
    scripts = F.try_element_at(F.from_json("manifest", "map<string, map<string, string>>", {"mode": "PERMISSIVE"}), F.lit("scripts"))
    steps = F.filter(F.array(*map(F.lit, ("check", "typecheck", "lint", "build", "test"))), lambda n: ~F.coalesce(F.try_element_at(scripts, n), F.lit("no test specified")).contains("no test specified"))
    found = found.select("*", F.coalesce(steps, F.array().cast("array<string>")).alias("steps"))
    install = F.when(F.col("pnpm"), "corepack enable && pnpm install --frozen-lockfile").when(F.col("yarn"), "corepack enable && yarn install --immutable").when(F.col("npm"), "npm ci").otherwise("npm install")
    run = F.when(F.col("pnpm"), "pnpm run ").when(F.col("yarn"), "yarn run ").otherwise("npm run ")
    node = F.when(F.size("steps") > 0, F.concat(install, F.lit(" && "), F.array_join(F.transform("steps", lambda x: F.concat(run, x)), " && ")))
    python = F.concat(F.when(F.col("requirements"), "python -m pip install -r requirements.txt").otherwise("python -m pip install -e ."), F.lit(" && python -m pytest"))
    command = F.coalesce(node, F.when(F.col("rust"), "cargo test"), F.when(F.col("go"), "go vet ./... && go test ./..."), F.when(F.col("pyproject") | F.col("requirements"), python))
    because = F.when(node.isNotNull(), F.concat(F.lit("package.json scripts: "), F.array_join("steps", ", "))).when(F.col("rust"), "Cargo.toml").when(F.col("go"), "go.mod").when(F.col("pyproject"), "pyproject.toml").otherwise("requirements.txt")
    rows = found.select("directory", command.alias("command"), because.alias("because")).where("command is not null")
    named = rows.select("*", F.concat(slug(F.element_at(F.split("directory", "/"), -1)), F.lit("-check")).alias("recipe"))
    alone = F.count("*").over(Window.partitionBy("recipe")) == 1
    return named.select("directory", F.when(alone, F.col("recipe")).otherwise(F.concat(slug(F.col("directory")), F.lit("-check"))).alias("recipe"), "command", "because")
