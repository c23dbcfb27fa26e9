"""Sitemap files through Spark's Python data source interface.

`df.write.format("sitemap")` takes rows (domain, shard, loc, lastmod, changefreq, priority), one sitemap a (domain,
shard), each in one task and in order. A task writes drafts; its commit message lists them. The job's commit gives every
draft the name that the sitemap index lists and writes the index file last; an abort removes all drafts, so a failed task
leaves no file. The folder is any that pyarrow's file systems reach from the executors.
"""

from __future__ import annotations

import sys
import uuid
from dataclasses import dataclass, field
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Fixed value: the sitemap protocol's namespace, and the URLs that a file may hold.
NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
MOST_URLS = 50_000
INDEX_NAME = "sitemap_index.xml"


def file_name(domain: str, shard: int) -> str:
    return f"sitemap_{domain}_{shard}.xml"


@dataclass
class Drafts(WriterCommitMessage):
    """(name, draft) of each file of a task."""

    files: list = field(default_factory=list)


class SitemapWriter(DataSourceWriter):
    def __init__(self, options, names: list[str], overwrite: bool):
        self.path, self.base = options["path"].rstrip("/"), options.get("base", "").rstrip("/")
        self.lastmod, self.names, self.overwrite = options.get("lastmod", ""), names, overwrite
        self.drafts = f"_drafts-{uuid.uuid4().hex}"

    def _fs(self):
        from pyarrow import fs

        where = self.path if "://" in self.path else f"file://{self.path.removeprefix('file:')}"
        return fs.FileSystem.from_uri(where)

    def write(self, rows) -> Drafts:
        files, root = self._fs()
        files.create_dir(f"{root}/{self.drafts}")
        done, now, out, held = Drafts(), None, None, 0

        def close():
            if out is not None:
                out.write(b"</urlset>\n")
                out.close()

        try:
            for row in rows:
                row = dict(zip(self.names, row))
                key = (row["domain"], row["shard"])
                if key != now:
                    close()
                    out = None
                    draft = f"{self.drafts}/{uuid.uuid4().hex}.xml"
                    out, now, held = files.open_output_stream(f"{root}/{draft}"), key, 0
                    done.files.append((file_name(*key), draft))
                    out.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="{NAMESPACE}">\n'.encode())
                held += 1
                if held > MOST_URLS:
                    raise ValueError(f"{file_name(*key)} would hold over {MOST_URLS} URLs")
                tags = "".join(f"<{c}>{escape(str(row[c]))}</{c}>" for c in ("loc", "lastmod", "changefreq", "priority") if row.get(c) is not None)
                out.write(f"  <url>{tags}</url>\n".encode())
            close()
            out = None
        except BaseException:
            if out is not None:
                out.close()
            for _, draft in done.files:
                files.delete_file(f"{root}/{draft}")
            raise
        return done

    def commit(self, messages) -> None:
        from pyarrow import fs

        files, root = self._fs()
        named = sorted(f for m in messages if m is not None for f in m.files)
        if len({name for name, _ in named}) < len(named):
            self.abort(messages)
            raise ValueError("rows of one sitemap came from several tasks: write them with write_sitemaps")
        if self.overwrite:
            for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if info.base_name.startswith("sitemap_") and info.base_name.endswith(".xml"):
                    files.delete_file(info.path)
        for name, draft in named:
            files.move(f"{root}/{draft}", f"{root}/{name}")
        with files.open_output_stream(f"{root}/{INDEX_NAME}") as out:
            out.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="{NAMESPACE}">\n'.encode())
            for name, _ in named:
                lastmod = f"<lastmod>{escape(self.lastmod)}</lastmod>" if self.lastmod else ""
                out.write(f"  <sitemap><loc>{escape(f'{self.base}/{name}')}</loc>{lastmod}</sitemap>\n".encode())
            out.write(b"</sitemapindex>\n")
        self._remove(files, root)

    def abort(self, messages) -> None:
        self._remove(*self._fs())

    def _remove(self, files, root) -> None:
        from pyarrow import fs

        if files.get_file_info(f"{root}/{self.drafts}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.drafts}")


class SitemapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sitemap"

    def writer(self, schema, overwrite: bool) -> SitemapWriter:
        return SitemapWriter(dict(self.options), schema.names, overwrite)


def write_sitemaps(rows: DataFrame, path: str, base: str, lastmod: str = "", mode: str = "overwrite") -> None:
    """sitemap_<domain>_<shard>.xml for each sitemap (null domain: its empty name) and sitemap_index.xml."""
    register(rows.sparkSession)
    named = rows.withColumn("domain", F.coalesce("domain", F.lit("")))
    dealt = named.repartition("domain", "shard").sortWithinPartitions("domain", "shard", "loc")
    writer = dealt.write.format("sitemap").mode(mode).option("base", base)
    writer.option("lastmod", lastmod).save(path)


def register(spark: SparkSession) -> None:
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no installed package
    spark.dataSource.register(SitemapSource)
