"""Backup and integrity-check planning."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.numbers import int_div, seconds_between
from fleetlens.functions.text import concat_text, file_system_name
from fleetlens.operators.distributed import all_of

# Default folder and file name templates, file extensions and limits.
DIRECTORY_STRUCTURE = (
    "{ServerName}${InstanceName}{DirectorySeparator}{DatabaseName}{DirectorySeparator}"
    "{BackupType}_{Partial}_{CopyOnly}"
)
GROUP_DIRECTORY_STRUCTURE = (
    "{ClusterName}${AvailabilityGroupName}{DirectorySeparator}{DatabaseName}{DirectorySeparator}"
    "{BackupType}_{Partial}_{CopyOnly}"
)
FILE_NAME = (
    "{ServerName}${InstanceName}_{DatabaseName}_{BackupType}_{Partial}_{CopyOnly}_"
    "{Year}{Month}{Day}_{Hour}{Minute}{Second}_{FileNumber}.{FileExtension}"
)
GROUP_FILE_NAME = (
    "{ClusterName}${AvailabilityGroupName}_{DatabaseName}_{BackupType}_{Partial}_{CopyOnly}_"
    "{Year}{Month}{Day}_{Hour}{Minute}{Second}_{FileNumber}.{FileExtension}"
)
# Tidying rules as (found, kept), in their order.
FILE_TIDYING = [
    ("__", "_"),
    ("--", "-"),
    ("_$", "_"),
    ("$_", "_"),
    ("-$", "-"),
    ("$-", "-"),
    ("_.", "."),
    ("-.", "."),
]
DIRECTORY_TIDYING = [
    ("__", "_"),
    ("--", "-"),
    ("//", "/"),
    ("/$", "/"),
    ("$/", "/"),
    ("/_", "/"),
    ("_/", "/"),
    ("/-", "/"),
    ("-/", "/"),
    ("_$", "_"),
    ("$_", "_"),
    ("-$", "-"),
    ("$-", "-"),
]
MAX_PATH_LENGTH = 259
SHORTEST_NAME = 20
MAX_FILES = 64
MAX_FILES_LIMITED_SOFTWARE = 32
LIMITED_SOFTWARE = ["SQLBACKUP", "DATA_DOMAIN_BOOST"]
LOGGED_MODELS = ["FULL", "BULK_LOGGED"]


def differential_base_snapshot(
    dbs: DataFrame, backups: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Databases with ``base_is_snapshot``: whether the differential base was a snapshot backup."""
    bases = (
        backups.filter("type = 'D' and checkpoint_lsn is not null")
        .groupBy(*keys, "database_name", F.col("checkpoint_lsn").alias("differential_base_lsn"))
        .agg(F.bool_or("is_snapshot").alias("base_is_snapshot"))
    )
    return dbs.join(bases, [*keys, "database_name", "differential_base_lsn"], "left")


def backup_type(
    dbs: DataFrame,
    requested: str | Column,
    change: bool = False,
    modification_level: int | None = None,
) -> DataFrame:
    """Databases with the ``backup_type`` to take.

    With ``change``, a log backup without a log chain becomes a differential one, and a differential
    backup becomes a full one for ``master``, without a base, from ``modification_level`` percent of
    modified pages on, or when the base is a snapshot.
    """
    wanted = F.lit(requested) if isinstance(requested, str) else requested
    if not change:
        return dbs.withColumn("backup_type", wanted)
    master = F.col("database_name") == "master"
    no_chain = (
        (wanted == "LOG")
        & F.col("recovery_model").isin(*LOGGED_MODELS)
        & F.col("last_log_backup_lsn").isNull()
        & ~master
    )
    first = F.when(no_chain, "DIFF").otherwise(wanted)
    to_full = master | F.col("differential_base_lsn").isNull()
    to_full = to_full | F.coalesce(F.col("base_is_snapshot"), F.lit(False))
    if modification_level is not None:
        pages = F.nullif(F.col("allocated_extent_page_count"), F.lit(0))
        share = F.col("modified_extent_page_count") * 100 >= pages * modification_level
        to_full = to_full | F.coalesce(share, F.lit(False))
    return dbs.withColumn(
        "backup_type", F.when((first == "DIFF") & to_full, "FULL").otherwise(first)
    )


#: Which member of an availability group takes a backup, by kind and whether it is copy-only.
#: ``preferred`` is the replica that the group's backup preference names.
TAKEN_BY = {
    ("FULL", False): "primary",
    ("FULL", True): "preferred",
    ("DIFF", False): "primary",
    ("DIFF", True): "primary",
    ("LOG", False): "preferred",
    ("LOG", True): "primary",
}


def _backed_up_from(kind: str) -> Column:
    """Whether there is what a backup of this kind continues."""
    if kind == "FULL":
        return F.lit(True)
    if kind == "DIFF":
        continued = F.col("differential_base_lsn").isNotNull()
    else:
        continued = F.col("recovery_model").isin(*LOGGED_MODELS) & F.col("last_log_backup_lsn").isNotNull()
    # The master database is always backed up whole.
    return continued & (F.col("database_name") != "master")


def _taken_here(kind: str, copy_only: bool, override_preference: bool) -> Column:
    """Whether this server is the one of its group that takes the backup; without a group it is."""
    alone = F.col("availability_group").isNull()
    if TAKEN_BY[kind, copy_only] == "primary":
        return alone | F.coalesce(F.col("role") == "PRIMARY", F.lit(False))
    if override_preference:
        return F.lit(True)
    return alone | F.coalesce("is_preferred_replica", F.lit(False))


def _log_due(asof: Column, min_log_size_mb: float, min_log_age_s: int) -> Column:
    """Enough log since the last backup, or long enough ago; unknown counts as due."""
    large = F.col("log_since_last_log_backup_mb") >= min_log_size_mb
    old = seconds_between("log_backup_time", asof) >= min_log_age_s
    return F.coalesce(large, F.lit(True)) | F.coalesce(old, F.lit(True))


def backup_eligible(
    dbs: DataFrame,
    asof: Column,
    copy_only: bool = False,
    override_preference: bool = False,
    updateability: str = "ALL",
    exclude_log_shipped: bool = False,
    min_log_size_mb: float | None = None,
    min_log_age_s: int | None = None,
    software: str | None = None,
) -> DataFrame:
    """Databases with ``eligible``: whether the planned ``backup_type`` can and should be taken.

    A database must be open to a backup, have what the kind of backup continues, be on the server
    that takes it (:data:`TAKEN_BY`), and be wanted by the run.  An answer that depends on something
    unknown (NULL) is no.
    """
    is_open = (
        (F.col("state_desc") == "ONLINE")
        & (F.col("is_accessible") | (F.col("user_access_desc") != "SINGLE_USER"))
        & ~F.col("is_in_standby")
    )
    wanted = {"READ_WRITE": [~F.col("is_read_only")], "READ_ONLY": [F.col("is_read_only")]}
    common = [is_open, *wanted.get(updateability, [])]
    log = []
    if exclude_log_shipped:
        log.append(~F.coalesce(F.col("log_shipping_role") == "PRIMARY", F.lit(False)))
    if min_log_size_mb is not None and min_log_age_s is not None:
        log.append(_log_due(asof, min_log_size_mb, min_log_age_s))
    if updateability == "READ_ONLY" and software == "DATA_DOMAIN_BOOST":
        log.append(F.lit(False))  # this software takes no logs of read-only databases

    verdict = F.lit(False)
    for kind in ("FULL", "DIFF", "LOG"):
        possible = all_of(
            *common,
            _backed_up_from(kind),
            _taken_here(kind, copy_only, override_preference),
            *(log if kind == "LOG" else []),
        )
        verdict = F.when(F.col("backup_type") == kind, possible).otherwise(verdict)
    return dbs.withColumn("eligible", F.coalesce(verdict, F.lit(False)))


def backup_size() -> Column:
    """Expected bytes of the planned ``backup_type``; pages are 8192 bytes."""
    kind = F.col("backup_type")
    return (
        F.when(
            kind == "FULL",
            F.coalesce("allocated_extent_page_count", "database_size").cast("bigint") * 8192,
        )
        .when(kind == "DIFF", F.col("modified_extent_page_count").cast("bigint") * 8192)
        .when(
            kind == "LOG",
            (F.col("log_since_last_log_backup_mb") * 1024 * 1024).cast("bigint"),
        )
    )


def backup_file_count(
    dbs: DataFrame,
    n_directories: int,
    n_files: int | None = None,
    min_size_for_multiple_mb: int | None = None,
    max_file_size_mb: int | None = None,
    software: str | None = None,
) -> DataFrame:
    """Databases with ``backup_size`` and ``number_of_files``.

    A given number of files is used from ``min_size_for_multiple_mb`` on; a greatest file size
    spreads the backup over as many files per directory as needed, up to the software's limit.
    """
    size = F.col("backup_size")
    directories = F.lit(n_directories)
    if n_files is None and software == "DATA_DOMAIN_BOOST":
        count = F.lit(1)
    elif n_files is None and max_file_size_mb is None:
        count = directories
    elif n_files == 1:
        count = F.lit(1)
    elif n_files is not None:
        if min_size_for_multiple_mb is None:
            count = F.lit(n_files)
        else:
            enough = size >= F.lit(min_size_for_multiple_mb * 1024 * 1024)
            count = F.when(size.isNull() | enough, n_files).otherwise(directories)
    else:
        limit = F.lit(max_file_size_mb * 1024 * 1024).cast("bigint")
        most = MAX_FILES_LIMITED_SOFTWARE if software in LIMITED_SOFTWARE else MAX_FILES
        share = int_div(size, n_directories)
        needed = int_div(share, limit) + F.when(share % limit == 0, 0).otherwise(1)
        per_directory = F.least(needed, F.lit(most // n_directories))
        count = F.when(size.isNull() | (size == 0), directories).otherwise(
            per_directory * n_directories
        )
    return dbs.withColumn("backup_size", backup_size()).withColumn(
        "number_of_files", count.cast("int")
    )


def stripe_files(plan: DataFrame, directories: Sequence[str] | Column) -> DataFrame:
    """One row per backup file: ``file_number``, ``directory_number``, ``directory_path``.

    The files are spread over the directories in equal, consecutive runs.  A number of files that
    the directories do not divide cannot be spread so; such a plan is refused with an error when its
    rows are made, and nothing is written to half of the folders.  ``directories`` is a list, or an
    array column.
    """
    paths = directories
    if not isinstance(paths, Column):
        paths = F.array(*[F.lit(d) for d in directories])
    files, folders = F.col("number_of_files"), F.size("_paths")
    uneven = F.raise_error(
        F.concat(files.cast("string"), F.lit(" files cannot be spread evenly over "),
                 folders.cast("string"), F.lit(" directories"))
    ).cast("int")
    even = (folders > 0) & (files % folders == 0)
    run = F.when(even, int_div(files, folders)).otherwise(uneven)
    number = (int_div(F.col("file_number") - 1, F.col("_run")) + 1).cast("int")
    return (
        plan.withColumn("_paths", paths)
        .withColumn("_run", run)
        .withColumn("file_number", F.explode(F.expr("sequence(1, _run * size(_paths))")))
        .withColumn("directory_number", number)
        .withColumn("directory_path", F.get("_paths", F.col("directory_number") - 1))
        .drop("_paths", "_run")
    )


def clean_template(template: Column, directory: bool = False) -> Column:
    """A template without the separators that dropped tokens left behind.

    The tidying rules are repeated until nothing changes.  A round that changes something removes a
    separator (or an ``of``), so their number bounds the rounds.  In a folder template the boundaries
    are written ``{DirectorySeparator}``, ``\\`` or ``/`` and come back as ``/``.
    """
    text = template
    if directory:
        text = F.regexp_replace(text, r"\{DirectorySeparator\}|\\", "/")
    rules = DIRECTORY_TIDYING if directory else FILE_TIDYING
    ends = ["_", "-", "$", "/"] if directory else ["_", "-", "$"]

    # Something is left to tidy.
    untidy = [re.escape(found) for found, _ in rules] + [rf"\A\{e}|\{e}\z" for e in ends]
    if not directory:
        untidy.append(r"(?i:of\.)")

    def one_round(text: Column) -> Column:
        value = text
        for found, kept in rules:
            value = F.replace(value, F.lit(found), F.lit(kept))
        if not directory:
            # "of" is left over from "<number>of<count>".
            value = F.regexp_replace(value, r"(?i)of\.", ".")
        for end in ends:
            value = F.regexp_replace(value, rf"\A\{end}|\{end}\z", "")
        return F.when(text.rlike("|".join(untidy)), value).otherwise(text)

    rounds = F.length(F.regexp_replace(text, r"(?i)of|[^_$/-]", "")) + F.regexp_count(
        text, F.lit("(?i)of")
    )
    steps = F.when(rounds > 0, F.sequence(F.lit(1), rounds)).otherwise(
        F.array().cast("array<int>")
    )
    return F.aggregate(steps, text, lambda value, _: one_round(value))


def _two(part: Column, width: int = 2) -> Column:
    return F.lpad(part.cast("string"), width, "0")


def date_tokens(asof: Column) -> dict[str, Column]:
    """Zero-padded date parts; weeks start on Sunday and week 1 holds January 1."""
    micro = F.date_format(asof, "SSSSSS")
    first = F.dayofweek(F.trunc(asof, "year"))
    week = int_div(F.dayofyear(asof) + first - 2, 7) + 1
    return {
        "Year": F.year(asof).cast("string"),
        "Month": _two(F.month(asof)),
        "Day": _two(F.day(asof)),
        "Week": _two(week),
        "Hour": _two(F.hour(asof)),
        "Minute": _two(F.minute(asof)),
        "Second": _two(F.second(asof)),
        "Millisecond": F.left(micro, F.lit(3)),
        "Microsecond": micro,
    }


#: Optional tokens of a template up to which all sets of them are tidied beforehand.
MAX_LOOKUP_TOKENS = 10


def _tidied(
    spark: SparkSession, template: str, names: Sequence[str], values: Mapping[str, Column], directory: bool
) -> Column:
    """The tidied template of a row, from a literal array with one text per set of NULL tokens."""
    text = F.lit(template)
    for i, name in enumerate(names):
        token = F.lit("{" + name + "}")
        text = F.replace(text, token, F.when(F.col("id").bitwiseAND(1 << i) != 0, "").otherwise(token))
    sets = spark.range(1 << len(names), numPartitions=1).withColumn("_template", text)
    found = sets.select("id", clean_template(F.col("_template"), directory).alias("t")).orderBy("id").collect()
    missing = F.lit(0)
    for i, name in enumerate(names):
        missing = missing + F.when(values[name].isNull(), 1 << i).otherwise(0)
    return F.get(F.from_json(F.lit(json.dumps([r["t"] for r in found])), "array<string>"), missing)


def render_template(
    df: DataFrame,
    template: str | Column,
    tokens: Mapping[str, Column],
    asof: Column,
    out: str,
    directory: bool = False,
    separator: str = "\\",
) -> DataFrame:
    """``df`` with the column ``out``: the template with its tokens replaced.

    A token whose value is NULL is dropped first, and the template is tidied
    (:func:`clean_template`) before any value is filled in, so values keep their characters.  A fixed
    template is tidied once for every set of dropped tokens, and rows look theirs up.
    """
    text = F.lit(template) if isinstance(template, str) else template
    values = {**date_tokens(asof), **tokens}
    if isinstance(template, str):
        values = {n: v for n, v in values.items() if "{" + n + "}" in template}
    dropped = [name for name in tokens if name in values]
    if isinstance(template, str) and len(dropped) <= MAX_LOOKUP_TOKENS:
        tidied = df.withColumn("_template", _tidied(df.sparkSession, template, dropped, values, directory))
    else:
        for name in dropped:
            # Replaced by itself when there is a value: the text so far must occur once per step.
            token = F.lit("{" + name + "}")
            text = F.replace(text, token, F.when(values[name].isNull(), "").otherwise(token))
        # Tidying looks at its input several times, so the steps are separate projections.
        tidied = df.withColumn("_template", text).withColumn(
            "_template", clean_template(F.col("_template"), directory)
        )
    text = F.col("_template")
    if directory:
        text = F.replace(text, F.lit("/"), F.lit(separator))
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return tidied.withColumn(out, text).drop("_template")


def description_token(description: Column) -> Column:
    """A free description reduced to file-name characters."""
    return F.ltrim(file_system_name(description))


def cap_database_name(
    file_name: Column, longest_path: Column, name: Column, number_of_files: Column
) -> Column:
    """A rendered file name with ``{DatabaseName}`` filled in, shortened if the path gets too long.

    A path may have 259 characters; the name keeps at least 20 of its own, followed by ``...``.
    ``longest_path`` is the length of the longest folder with its separator.
    """
    digits = F.when(number_of_files >= 10, "01").otherwise("1")
    filled = F.replace(F.replace(file_name, F.lit("{DatabaseName}"), name),
                       F.lit("{FileNumber}"), digits)
    length = longest_path + F.length(filled)
    room = F.length(name) + MAX_PATH_LENGTH - length - 3
    short = concat_text(F.left(name, F.greatest(room, F.lit(SHORTEST_NAME))), "...")
    value = F.when(length > MAX_PATH_LENGTH, short).otherwise(name)
    return F.replace(file_name, F.lit("{DatabaseName}"), value)


def file_number_text(number: Column, number_of_files: Column) -> Column:
    """File number, with two digits from ten files on."""
    return F.when(number_of_files >= 10, _two(number)).otherwise(number.cast("string"))


def cleanup_cutoff(
    dbs: DataFrame,
    backups: DataFrame,
    hours: int | None,
    asof: Column,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Databases with ``cleanup_date``: backup files older than it may be deleted.

    The earliest of now, ``hours`` ago and, for log backups, the start of the latest undamaged full
    or differential backup (or log backup older than the differential base).  NULL, i.e. no cleanup,
    when ``hours`` is NULL or a log backup has no such backup.
    """
    base = dbs.select(*keys, "database_name", "differential_base_lsn").distinct()
    latest = (
        backups.filter(~F.col("is_damaged"))
        .join(base, [*keys, "database_name"])
        .filter(
            F.col("type").isin("D", "I")
            | ((F.col("type") == "L") & (F.col("last_lsn") < F.col("differential_base_lsn")))
        )
        .groupBy(*keys, "database_name")
        .agg(F.max("backup_start_date").alias("latest_backup"))
    )
    if hours is None:
        return dbs.join(latest, [*keys, "database_name"], "left").withColumn(
            "cleanup_date", F.lit(None).cast("timestamp_ntz")
        )
    ago = asof - F.make_dt_interval(hours=F.lit(hours))
    is_log = F.col("backup_type") == "LOG"
    cutoff = F.when(
        is_log & F.col("latest_backup").isNotNull(), F.least(asof, ago, F.col("latest_backup"))
    ).when(~is_log, F.least(asof, ago))
    return dbs.join(latest, [*keys, "database_name"], "left").withColumn("cleanup_date", cutoff)


def check_eligible(
    dbs: DataFrame,
    replicas: str = "ALL",
    updateability: str = "ALL",
    edition: int = 3,
) -> DataFrame:
    """Databases with ``eligible``: whether an integrity check can run.

    ``replicas`` is ``ALL``, ``PRIMARY``, ``SECONDARY`` or ``PREFERRED_BACKUP_REPLICA``.
    """
    role = F.col("role")
    by_role = (
        (F.lit(replicas == "PRIMARY") & (role == "PRIMARY"))
        | (F.lit(replicas == "SECONDARY") & (role == "SECONDARY"))
        | (F.lit(replicas == "PREFERRED_BACKUP_REPLICA") & F.col("is_preferred_replica"))
        | F.lit(replicas == "ALL")
        | role.isNull()
    )
    verdict = (
        F.col("state_desc").isin("ONLINE", "EMERGENCY")
        & ~((F.col("user_access_desc") == "SINGLE_USER") & ~F.col("is_accessible"))
        & ((role == "PRIMARY") | role.isNull() | F.lit(edition == 3))
        & by_role
        & ~(F.col("is_read_only") & F.lit(updateability == "READ_WRITE"))
        & ~(~F.col("is_read_only") & F.lit(updateability == "READ_ONLY"))
    )
    return dbs.withColumn("eligible", F.coalesce(verdict, F.lit(False)))
