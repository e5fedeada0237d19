"""Image keys, paths and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def image_no(key: Column) -> Column:
    """The 1-based image number before the ``@``; zero padding does not matter."""
    return F.split(key, "@", 2)[0].try_cast("int")


def stack_name(key: Column) -> Column:
    """The stack path after the ``@``."""
    return F.try_element_at(F.split(key, "@", 2), F.lit(2))


def image_key(number: Column, stack: Column, width: int = 6) -> Column:
    """``000012@stack``; numbers wider than the padding keep all their digits."""
    text = number.cast("string")
    padded = F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))
    return F.concat_ws("@", padded, stack)


def base_name(path: Column) -> Column:
    """The part after the last slash."""
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """The part before the last slash, empty without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def clean_path(
    path: Column,
    drop_directory: bool = False,
    drop_digit_prefix: bool = False,
    drop_particles_suffix: bool = False,
    new_directory: str | None = None,
) -> Column:
    """Normalise a path written by another program.

    Backslashes become slashes and leading ``>`` go in every case. A new directory wins
    over dropping the directory.
    """
    text = F.regexp_replace(F.translate(path, "\\", "/"), "^>+", "")
    name = base_name(text)
    if drop_digit_prefix:
        name = F.regexp_replace(name, r"^\d+_", "")
    if drop_particles_suffix:
        name = F.regexp_replace(name, r"_particles(\.[^.]*)?$", "$1")
    if new_directory is not None:
        folder = new_directory.replace("\\", "/").rstrip("/")
        return F.concat(F.lit(folder + "/" if folder else ""), name)
    if drop_directory:
        return name
    folder = directory(text)
    return F.when(folder != "", F.concat_ws("/", folder, name)).otherwise(name)


def stack_base(path: Column) -> Column:
    """Base name without a leading run of at least eight digits and an underscore."""
    return F.regexp_replace(base_name(F.trim(path)), r"^\d{8,}_", "")


def simple_name(path: Column) -> Column:
    """Base name without extension and without the characters ``.``, ``_`` and ``-``."""
    return F.translate(F.regexp_replace(base_name(path), r"\.[^.]*$", ""), "._-", "")


def drop_name_prefix(key: Column) -> Column:
    """Drop the file name's part up to its first underscore; folder and number stay."""
    at = F.when(F.instr(key, "@") > 0, F.concat(F.substring_index(key, "@", 1), F.lit("@"))).otherwise(F.lit(""))
    path = F.substring_index(key, "@", -1)
    folder = F.when(F.instr(path, "/") > 0, F.concat(directory(path), F.lit("/"))).otherwise(F.lit(""))
    name = base_name(path)
    return F.concat(at, folder, F.regexp_replace(name, r"^[^_]*_", ""))


def replace_stack(key: Column, stack: str) -> Column:
    """Keep the image number, point to another stack."""
    return F.concat(F.substring_index(key, "@", 1), F.lit("@" + stack))


def last_parts(path: Column, depth: int) -> Column:
    """The last ``depth + 1`` parts of a path."""
    return F.substring_index(path, "/", -(depth + 1))


def normal_path(path: Column) -> Column:
    """Drop ``.`` parts and doubled slashes, and let ``..`` take back the part before it.

    A relative path keeps the ``..`` that lead above its start; an absolute one has none
    above its root. What is left empty is ``.``; a slash at the end stays.
    """
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(kept: Column, part: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        back = F.when(last.isNull(), F.when(rooted, kept).otherwise(F.array_append(kept, part))).when(
            last == "..", F.array_append(kept, part)
        )
        shorter = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part == "..", back.otherwise(shorter)).otherwise(F.array_append(kept, part))

    plain = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    plain = F.when(path.endswith("/") & (plain != ""), F.concat(plain, F.lit("/"))).otherwise(plain)
    return F.when(rooted, F.concat(F.lit("/"), plain)).when((plain == "") & (path != ""), ".").otherwise(plain)


def is_true_word(word: Column) -> Column:
    """Whether a word means true."""
    from motes.functions.fixed import TRUE_WORDS

    return F.lower(F.trim(word)).isin(TRUE_WORDS)
