"""Windows path expressions.

Path comparison is case-sensitive unless a rule says otherwise, and every lowering is
ASCII only, so ``translate`` over the 26 letters is used in place of ``lower``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import PE_EXTENSIONS, UNNAMED

BACKSLASH = "\\"
_REST = 2**31 - 1  # "to the end" for substring
_ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def ascii_lower_text(text: str) -> str:
    return text.translate(_ASCII_LOWER)


def normalize_prefix_text(prefix: str) -> str:
    """Prefix rules: backslashes only, ASCII-lowered, no trailing separator."""
    return ascii_lower_text(prefix.replace("/", BACKSLASH)).rstrip(BACKSLASH)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def normalize_prefix(col: Column) -> Column:
    """Column form of :func:`normalize_prefix_text`."""
    return F.rtrim(ascii_lower(F.translate(col, "/", BACKSLASH)), F.lit(BACKSLASH))


def slashed(col: Column) -> Column:
    """The path with forward separators only."""
    return F.translate(col, BACKSLASH, "/")


def last_component(col: Column) -> Column:
    """Text after the last separator of either kind (empty when the path ends in one)."""
    return F.substring_index(slashed(col), "/", -1)


def basename(col: Column) -> Column:
    """Last component, ignoring trailing separators; a fixed name when there is none."""
    base = F.substring_index(F.rtrim(slashed(col), F.lit("/")), "/", -1)
    nameless = base.isin("", "..") | ((F.length(base) == 2) & starts_with_drive(base))
    return F.when(nameless, F.lit(UNNAMED)).otherwise(base)


def name_extension(col: Column) -> Column:
    """Lowered extension of the last component; a leading or trailing dot does not count."""
    base = last_component(col)
    suffix = F.substring_index(base, ".", -1)
    real = F.contains(base, F.lit(".")) & (suffix != "") & (F.length(base) > F.length(suffix) + 1)
    return F.when(real, ascii_lower(suffix)).otherwise(F.lit(""))


def path_extension(col: Column) -> Column:
    """Lowered text after the last dot of the *whole* path (hashing and batch triage)."""
    return F.when(
        F.contains(col, F.lit(".")), ascii_lower(F.substring_index(col, ".", -1))
    ).otherwise(F.lit(""))


def has_pe_path_extension(col: Column) -> Column:
    return path_extension(col).isin(*PE_EXTENSIONS)


def has_pe_name_extension(col: Column) -> Column:
    return name_extension(col).isin(*PE_EXTENSIONS)


def self_and_ancestors(col: Column) -> Column:
    """Array of each ancestor and the path itself, cut before a separator of either kind."""
    parts = F.length(col) - F.length(F.replace(slashed(col), F.lit("/"), F.lit(""))) + 1
    return F.transform(
        F.sequence(F.lit(1), parts),
        lambda i: F.left(col, F.length(F.call_function("substring_index", slashed(col), F.lit("/"), i))),
    )


def volume_label(mount: Column, guid_path: Column) -> Column:
    """Mount point without its trailing backslash, else the whole GUID path."""
    return F.coalesce(F.rtrim(mount, F.lit(BACKSLASH)), guid_path)


def starts_with_drive(col: Column) -> Column:
    """A letter and a colon, tested without a pattern: this runs for every change record."""
    letter = F.substring(col, 1, 1)
    is_letter = letter.between("A", "Z") | letter.between("a", "z")
    return (F.substring(col, 2, 1) == ":") & is_letter


def record_path(path: Column, mount: Column) -> Column:
    """Path of a change record in plain drive form.

    With a drive mount: drop the ``\\\\?\\X:`` or ``\\\\.\\X:`` form of that drive, and put the
    drive in front of unqualified paths. Otherwise strip ``\\\\?\\`` before any drive letter;
    GUID paths stay as they are. Paths that already start with a drive, nearly all of them,
    leave at the first test.
    """
    label = F.rtrim(F.rtrim(mount, F.lit(BACKSLASH)), F.lit("/"))
    on_drive = F.coalesce((F.length(label) == 2) & starts_with_drive(label), F.lit(False))
    extended = F.lit("\\\\?\\")
    own_drive = F.substring(path, 1, 4).isin("\\\\?\\", "\\\\.\\") & (
        ascii_lower(F.substring(path, 5, 2)) == ascii_lower(label)
    )
    network = F.startswith(path, F.lit("\\\\")) | F.startswith(path, F.lit("//"))
    rooted = F.startswith(path, F.lit(BACKSLASH)) | F.startswith(path, F.lit("/"))
    other_drive = F.startswith(path, extended) & starts_with_drive(F.substring(path, 5, 2))
    return (
        F.when(starts_with_drive(path), path)
        .when(on_drive & own_drive, F.concat(label, F.substring(path, 7, _REST)))
        .when(on_drive & ~network & rooted, F.concat(label, path))
        .when(on_drive & ~network, F.concat(label, F.lit(BACKSLASH), path))
        .when(other_drive, F.substring(path, 5, _REST))
        .otherwise(path)
    )
