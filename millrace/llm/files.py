"""Files in the shared folder, read and written by Python workers through pyarrow's file systems.

Names are those of the cluster's store (file, hdfs, s3, gs ...), never of a worker's own disk.
"""

from __future__ import annotations

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    return fs.FileSystem.from_uri(uri)


def commit(store: fs.FileSystem, temporary: str, final: str) -> None:
    """Gives a finished file its name; a second attempt at the same content replaces the first.

    Between the two steps of a replacement the name is missing. No reader sees that, as readers open
    only what a manifest lists, and the manifest is written when all tasks have finished.
    """
    try:
        store.move(temporary, final)
    except OSError:
        if store.get_file_info(final).type != fs.FileType.File:
            raise
        store.delete_file(final)
        store.move(temporary, final)
