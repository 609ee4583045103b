"""What documents hold: front matter, headings, equations, tables, references, signatures, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql.functions.text import bare_doi, strip_closing
from corpusql.operators.search import front_field

# Operators among the commands of LaTeX, and phrases of claims.
LATEX_OPERATORS = ["frac", "sum", "cdot", "bar", "left", "right", "sqrt", "int", "partial", "times", "log", "ln", "exp", "text", "mathrm"]
CLAIM_PHRASES = r"(suggests that|reported that|revealed that|shows? that|has been (?:widely|shown)|is known to|we attribute)"


def _text(documents: DataFrame) -> DataFrame:
    """Texts with one kind of line end."""
    return documents.filter("text IS NOT NULL").withColumn("text", F.regexp_replace("text", r"\r\n?", "\n"))


def lines(documents: DataFrame) -> DataFrame:
    """doc_id, n (0-based), line of every document."""
    return _text(documents).select("doc_id", "doc_kind", "entry_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))


def front_matter(documents: DataFrame) -> DataFrame:
    """doc_id, title, year, topic of documents that begin with front matter."""
    text = F.col("text")
    docs = _text(documents).filter(text.rlike(r"(?s)^---\n.*?\n---"))
    return docs.select("doc_id", front_field(text, "title").alias("title"), front_field(text, "year").try_cast("int").alias("year"), front_field(text, "topic").alias("topic"))


def metadata(documents: DataFrame) -> DataFrame:
    """doc_id, title, doi, year: front matter first, else the first heading, DOI and bracketed year of the text (a DOI not after the references)."""
    body = F.regexp_replace("text", r"(?is)\n#{0,3} *(references|bibliography)\b.*$", "")
    title = F.coalesce(F.nullif(front_field(F.col("text"), "title"), F.lit("")), F.regexp_extract("text", r"(?m)^#+ +([^\n]+)", 1))
    year = F.coalesce(front_field(F.col("text"), "year").try_cast("int"), F.regexp_extract("text", r"\(((?:19|20)\d\d)\)", 1).try_cast("int"))
    return _text(documents).select("doc_id", title.alias("title"), F.coalesce(bare_doi(F.regexp_extract(body, r"10\.\d{4,9}/[^\s\"<>]+", 0)), F.lit("")).alias("doi"), year.alias("year"))


def headings(documents: DataFrame) -> DataFrame:
    """doc_id, n, level, title of markdown headings."""
    hit = F.col("line").rlike(r"^#{1,6} +\S")
    return lines(documents).filter(hit).select("doc_id", "n", F.length(F.regexp_extract("line", r"^(#+)", 1)).alias("level"), F.trim(F.regexp_extract("line", r"^#+ +(.*)$", 1)).alias("title"))


def line_sections(documents: DataFrame) -> DataFrame:
    """doc_id, section, n_lines, n_chars: lines as they stand under their nearest heading before (as-of within a document)."""
    here = F.when(F.col("line").rlike(r"^#{1,6} +\S"), F.trim(F.regexp_extract("line", r"^#+ +(.*)$", 1)))
    at = W.partitionBy("doc_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    under = lines(documents).withColumn("section", F.coalesce(F.last(here, ignorenulls=True).over(at), F.lit("")))
    return under.groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def equations(documents: DataFrame) -> DataFrame:
    """doc_id, item, latex, number, section of display equations, in the order of the text.

    The number is the bracketed one that follows at once; the section is the last heading before.
    """
    parts = _text(documents).filter(F.contains("text", F.lit("$$"))).select("doc_id", F.split("text", r"\$\$").alias("p"))
    n = F.floor((F.size("p") - 1) / 2).cast("int")
    each = parts.filter(n > 0).select("doc_id", "p", F.explode(F.sequence(F.lit(0), n - 1)).alias("item"))
    before = F.array_join(F.slice("p", 1, F.col("item") * 2 + 1), "$$")
    heads = F.regexp_extract_all(before, F.lit(r"(?m)^#{1,6} +([^\n]*)$"), F.lit(1))
    latex, after = F.get("p", F.col("item") * 2 + 1), F.coalesce(F.get("p", F.col("item") * 2 + 2), F.lit(""))
    return each.select(
        "doc_id", "item", F.trim(F.regexp_replace(latex, r"\s+", " ")).alias("latex"), F.regexp_extract(after, r"^\s{0,20}\(([0-9A-Z.]+)\)", 1).alias("number"),
        F.coalesce(F.try_element_at(heads, F.lit(-1)), F.lit("")).alias("section"),
    )


def is_math(latex: Column) -> Column:
    """Two characters or more, no list of citation numbers, and a sign that formulas have."""
    s = F.trim(latex)
    return (F.length(s) >= 2) & ~s.rlike(r"^\^?\{?[\d,\s-]+\}?$") & s.rlike(r"[=\\_^]")


def equation_contexts(documents: DataFrame, chars: int = 120) -> DataFrame:
    """doc_id, item, is_math, context: the text around the start of each display equation, without ``$`` and with single blanks."""
    docs = _text(documents).filter(F.contains("text", F.lit("$$"))).select("doc_id", "text", F.split("text", r"\$\$").alias("p"))
    n = F.floor((F.size("p") - 1) / 2).cast("int")
    each = docs.filter(n > 0).withColumn("item", F.explode(F.sequence(F.lit(0), n - 1)))
    at = F.aggregate(F.slice("p", 1, F.col("item") * 2 + 1), F.lit(0), lambda a, x: a + F.length(x) + 2) - 2  # lengths alone: no text is joined
    start = F.greatest(at - chars // 2, F.lit(0))
    around = F.replace(F.substring("text", start + 1, at + chars // 2 - start), F.lit("$"), F.lit(""))
    context = F.left(F.trim(F.regexp_replace(around, r"\s+", " ")), F.lit(chars))
    return each.select("doc_id", "item", is_math(F.get("p", F.col("item") * 2 + 1)).alias("is_math"), context.alias("context"))


def symbols(latex: Column) -> Column:
    """Sorted distinct symbols of a formula: Greek letters, letters with subscripts, single letters."""
    commands = F.filter(F.regexp_extract_all(latex, F.lit(r"\\([a-zA-Z]+)"), F.lit(1)), lambda c: ~c.isin(LATEX_OPERATORS))
    subscripts = F.transform(F.regexp_extract_all(latex, F.lit(r"[A-Za-z]_(?:\{[A-Za-z0-9,]+\}|[A-Za-z0-9])"), F.lit(0)), lambda s: F.translate(s, "{}", ""))
    bare = F.regexp_replace(F.regexp_replace(latex, r"\\[a-zA-Z]+", " "), r"[A-Za-z]_(\{[^}]*\}|[A-Za-z0-9])|\{[A-Za-z]{2,}\}|[A-Za-z]{2,}", " ")
    letters = F.filter(F.regexp_extract_all(bare, F.lit("[A-Za-z]"), F.lit(0)), lambda c: ~c.isin("d", "e", "i"))
    return F.array_sort(F.array_distinct(F.concat(commands, subscripts, letters)))


def equation_symbols(scanned: DataFrame) -> DataFrame:
    """symbol, n_equations, n_papers over the equations of scanned papers."""
    each = scanned.select("scan_id", F.explode("equations").alias("e")).select("scan_id", F.explode(symbols(F.col("e.latex"))).alias("symbol"))
    return each.groupBy("symbol").agg(F.count("*").alias("n_equations"), F.count_distinct("scan_id").alias("n_papers"))


def equation_counts(scanned: DataFrame) -> DataFrame:
    """scan_id, n_display, n_inline, n_numbered, n_tables, n_rows of each scanned paper."""
    e, t = F.coalesce("equations", F.array()), F.coalesce("ext_tables", F.array())
    return scanned.select(
        "scan_id", F.size(F.filter(e, lambda x: x.display)).alias("n_display"), F.size(F.filter(e, lambda x: ~x.display)).alias("n_inline"),
        F.size(F.filter(e, lambda x: F.coalesce(x.number, F.lit("")) != "")).alias("n_numbered"), F.size(t).alias("n_tables"),
        F.aggregate(t, F.lit(0), lambda a, x: a + F.size(F.coalesce(x["rows"], F.array().cast("array<array<string>>")))).alias("n_rows"),
    )


def padded_rows(scanned: DataFrame) -> DataFrame:
    """scan_id, item, row_no, cells, was_ragged: table rows brought to the width of their header."""
    tables = scanned.select("scan_id", F.posexplode("ext_tables").alias("item", "t")).select("scan_id", "item", F.size("t.headers").alias("w"), F.posexplode("t.rows").alias("row_no", "r"))
    cells = F.slice(F.concat("r", F.array_repeat(F.lit(""), F.col("w"))), 1, F.col("w"))
    return tables.filter("w > 0").select("scan_id", "item", "row_no", F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), "|").alias("cells"), (F.size("r") != F.col("w")).alias("was_ragged"))


def markdown_tables(documents: DataFrame) -> DataFrame:
    """doc_id, first_line, header, n_rows of tables in the text: runs of lines between bars whose second line is a rule."""
    bar = lines(documents).filter(F.col("line").rlike(r"^\s*\|.*\|\s*$")).select("doc_id", "n", F.trim("line").alias("line"))
    run = bar.withColumn("run", F.col("n") - F.row_number().over(W.partitionBy("doc_id").orderBy("n")))
    rule = F.col("line").rlike(r"^\|[ :|-]+\|$")
    tables = run.groupBy("doc_id", "run").agg(F.min("n").alias("first_line"), F.min(F.struct("n", "line")).alias("h"), F.min(F.when(rule, F.col("n"))).alias("rule_at"), F.count("*").alias("k"))
    return tables.filter(F.col("rule_at") == F.col("first_line") + 1).select("doc_id", "first_line", F.col("h.line").alias("header"), (F.col("k") - 2).alias("n_rows"))


def table_captions(documents: DataFrame) -> DataFrame:
    """doc_id, first_line, caption of tables in the text: the last line before that is not blank, if it names a table or is shorter than 200; else ``""``."""
    before = W.partitionBy("doc_id").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    above = F.last(F.nullif(F.trim("line"), F.lit("")), ignorenulls=True).over(before)
    bar = lines(documents.filter(F.contains("text", F.lit("|")))).select("doc_id", "n", "line", above.alias("above")).filter(F.col("line").rlike(r"^\s*\|.*\|\s*$"))
    run = bar.withColumn("run", F.col("n") - F.row_number().over(W.partitionBy("doc_id").orderBy("n")))
    rule = F.trim("line").rlike(r"^\|[ :|-]+\|$")
    tables = run.groupBy("doc_id", "run").agg(F.min(F.struct("n", "above")).alias("h"), F.min(F.when(rule, F.col("n"))).alias("rule_at")).filter(F.col("rule_at") == F.col("h.n") + 1)
    named = F.col("h.above").rlike(r"(?i)^(\*\*)?table\s+\d")
    caption = F.when(named, F.trim(F.regexp_replace("h.above", r"^\*+|\*+$", ""))).when((F.length("h.above") < 200) & ~F.startswith("h.above", F.lit("|")), F.col("h.above"))
    return tables.select("doc_id", F.col("h.n").alias("first_line"), F.coalesce(caption, F.lit("")).alias("caption"))


def annotations(documents: DataFrame) -> DataFrame:
    """doc_id, n, identifier, kind, location of ``REF:`` comments in source files."""
    hit = F.regexp_extract("line", r"(?:^|[#!/%;]\s*)REF:\s*(?:doi:)?(\S+)", 1)
    found = lines(documents).withColumn("identifier", strip_closing(hit)).filter("identifier <> ''")
    kind = F.when(F.col("identifier").startswith("10."), "doi").otherwise("paper_id")
    return found.select("doc_id", "n", "identifier", kind.alias("kind"), F.trim(F.regexp_extract("line", r"REF:\s*\S+\s+(.*)$", 1)).alias("location"))


def annotation_summary(documents: DataFrame) -> DataFrame:
    """kind, n_refs, n_docs, n_identifiers."""
    return annotations(documents).groupBy("kind").agg(F.count("*").alias("n_refs"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("identifier").alias("n_identifiers"))


def resolved_refs(refs: DataFrame, entries: DataFrame) -> DataFrame:
    """ref_id, identifier, found, entry_id: references looked up by id or DOI; of entries with one DOI the smallest id."""
    is_doi = F.col("identifier").rlike(r"(^|[/:\s])10\.[0-9]+/")
    r = refs.filter("identifier IS NOT NULL").select("ref_id", F.when(is_doi, bare_doi("identifier")).otherwise(strip_closing(F.lower("identifier"))).alias("identifier"), is_doi.alias("is_doi")).filter("identifier <> ''").distinct()
    by_doi = entries.select(bare_doi("doi").alias("identifier"), "id").filter("identifier IS NOT NULL").groupBy("identifier").agg(F.min("id").alias("entry_id")).withColumn("is_doi", F.lit(True))
    by_id = entries.select(F.lower("id").alias("identifier"), F.col("id").alias("entry_id"), F.lit(False).alias("is_doi"))
    return r.join(by_doi.unionByName(by_id), ["identifier", "is_doi"], "left").select("ref_id", "identifier", F.col("entry_id").isNotNull().alias("found"), "entry_id")


def code_signatures(documents: DataFrame) -> DataFrame:
    """doc_id, n, kind, name of definitions in source files."""
    rx = r"^\s*(?:pure |elemental |public |static )*(def|class|subroutine|function|void|double)\s+([A-Za-z_]\w*)"
    return lines(documents).filter("doc_kind = 'source_file'").filter(F.col("line").rlike(rx)).select("doc_id", "n", F.regexp_extract("line", rx, 1).alias("kind"), F.regexp_extract("line", rx, 2).alias("name"))


def codebase_profile(documents: DataFrame) -> DataFrame:
    """entry_id, n_files, n_lines, n_blank, n_comments, n_definitions, n_refs of each codebase."""
    at = F.col("line")
    return lines(documents).filter("doc_kind = 'source_file' AND entry_id IS NOT NULL").groupBy("entry_id").agg(
        F.count_distinct("doc_id").alias("n_files"), F.count("*").alias("n_lines"), F.count_if(F.trim(at) == "").alias("n_blank"),
        F.count_if(at.rlike(r"^\s*(#|!|//|%)")).alias("n_comments"), F.count_if(at.rlike(r"^\s*(def|class|subroutine|function|void|double)\s+[A-Za-z_]")).alias("n_definitions"),
        F.count_if(at.rlike(r"REF:\s*\S")).alias("n_refs"),
    )


def concepts(documents: DataFrame, limit: int = 50) -> DataFrame:
    """concept, n, n_docs: parts of the names that source files define, most frequent first."""
    names = code_signatures(documents).select("doc_id", F.explode(F.split(F.lower(F.regexp_replace("name", r"(?<=[a-z])(?=[A-Z])", "_")), "_")).alias("concept"))
    return names.filter(F.length("concept") > 2).groupBy("concept").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs")).orderBy(F.desc("n"), "concept").limit(limit)


def pitfalls(documents: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """doc_id, warning, n: source files in which a pitfall's pattern (any case) occurs, and how often."""
    hits = [F.struct(F.lit(w).alias("warning"), F.regexp_count("text", F.lit(f"(?i){p}")).alias("n")) for p, w in patterns.items()]
    return documents.filter("doc_kind = 'source_file' AND text IS NOT NULL").select("doc_id", F.inline(F.array(*hits))).filter("n > 0")


def api_functions(documents: DataFrame) -> DataFrame:
    """doc_id, package, name, params of the functions on API pages; of one name on a page the first."""
    package = F.regexp_extract("text", r"(?m)^# API: *(\S+)", 1)
    sig = F.posexplode(F.regexp_extract_all("text", F.lit(r"(?m)^### `([^`]+)`"), F.lit(1))).alias("n", "sig")
    each = _text(documents).filter("doc_kind = 'api'").select("doc_id", package.alias("package"), sig).filter("package <> ''")
    name = F.regexp_extract("sig", r"^([A-Za-z_][\w.]*)\(", 1)
    params = F.regexp_replace(F.regexp_replace(F.regexp_extract("sig", r"\(([^)]*)\)", 1), r"\s*[:=][^,]*", ""), r"\s*,\s*", ",")
    first = each.withColumn("name", name).filter("name <> ''").groupBy("doc_id", "package", "name").agg(F.min(F.struct("n", params.alias("params"))).alias("f"))
    return first.select("doc_id", "package", "name", F.col("f.params").alias("params"))


def api_diff(documents: DataFrame) -> DataFrame:
    """package, name, change (``added``, ``removed``, ``changed`` or ``same``): first against last API page of each package that has several."""
    f = api_functions(documents)
    pages = f.groupBy("package").agg(F.min("doc_id").alias("old"), F.max("doc_id").alias("new")).filter("old < new")
    side = lambda which: f.join(pages.select("package", F.col(which).alias("doc_id")), ["package", "doc_id"]).select("package", "name", F.col("params").alias(which))
    both = side("old").join(side("new"), ["package", "name"], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return both.select("package", "name", change.alias("change"))


def claims(documents: DataFrame) -> DataFrame:
    """doc_id, claim: sentences of at least 20 characters with a claim's phrase and no citation."""
    sentences = F.explode(F.split(F.regexp_replace("text", r"\s+", " "), r"(?<=[.!?]) "))
    s = documents.filter("text IS NOT NULL AND doc_kind IN ('section', 'note')").select("doc_id", sentences.alias("claim"))
    cited = F.col("claim").rlike(r"\[\d+\]|\([^()]*(?:19|20)\d\d\)")
    return s.filter((F.length("claim") >= 20) & F.lower("claim").rlike(CLAIM_PHRASES) & ~cited).select("doc_id", F.trim("claim").alias("claim")).distinct()


def citations(documents: DataFrame) -> DataFrame:
    """name, year, n_docs, n: citations of the form ``Name (year)``."""
    each = documents.filter("text IS NOT NULL").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{Ll}+ \((?:19|20)\d\d\)"), F.lit(0))).alias("c"))
    return each.groupBy(F.split_part("c", F.lit(" "), F.lit(1)).alias("name"), F.regexp_extract("c", r"(\d{4})", 1).cast("int").alias("year")).agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n"))
