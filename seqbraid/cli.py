"""Command line: cluster a file of sequences and write the result as text."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from seqbraid import api
from seqbraid.functions.strings import output_name
from seqbraid.sources import reads as sources, render

VERSION = "0.1"


class _Parser(argparse.ArgumentParser):
    """Takes each option once."""

    def parse_known_args(self, args=None, namespace=None):
        named = [self._option_string_actions.get(x.partition("=")[0] if x.startswith("--") else x[:2]) for x in (sys.argv[1:] if args is None else args) if x.startswith("-") and x != "-"]
        seen = [a.dest for a in named if a is not None]
        if repeated := sorted({x for x in seen if seen.count(x) > 1}):
            self.error(f"more than once: {', '.join(repeated)}")
        return super().parse_known_args(args, namespace)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="seqbraid", description=__doc__, allow_abbrev=False)
    p.add_argument("path", nargs="?", help="input file (default: standard input)")
    p.add_argument("-i", "--input")
    p.add_argument("-1", "--input1")
    p.add_argument("-2", "--input2")
    p.add_argument("-o", "--output", help="output folder (default: standard output)")
    p.add_argument("--output1")
    p.add_argument("--output2")
    p.add_argument("-d", "--dist", "--distance", type=int, dest="distance")
    p.add_argument("-r", "--cluster-ratio", type=float)
    p.add_argument("-s", "--sphere", "--spheres", action="store_true", dest="sphere")
    p.add_argument("-c", "--connected-comp", action="store_true")
    p.add_argument("--print-clusters", action="store_true")
    p.add_argument("--seq-id", action="store_true")
    p.add_argument("--non-redundant", action="store_true")
    p.add_argument("--tidy", action="store_true")
    p.add_argument("-t", "--threads", type=int, default=1)
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("-v", "--version", action="version", version=VERSION)
    p.add_argument("--umi-len", type=int, help="cluster tags of this length and the sequences behind them")
    p.add_argument("--umi-d", type=int, default=0)
    p.add_argument("--seq-d", type=int, default=-1)
    p.add_argument("--seq-trim", type=int, default=50)
    p.add_argument("--umi-cluster", choices=["mp", "s", "cc"], default="mp")
    p.add_argument("--seq-cluster", choices=["mp", "s", "cc"], default="mp")
    p.add_argument("--umi-cluster-ratio", type=int, default=3)
    p.add_argument("--seq-cluster-ratio", type=int, default=3)
    return p


def check(p: argparse.ArgumentParser, o: argparse.Namespace) -> None:
    """Options that exclude or need each other."""
    if o.distance is not None and o.distance > 8:
        p.error("--dist must be at most 8")
    if o.cluster_ratio is not None and o.cluster_ratio < 1:
        p.error("--cluster-ratio must be at least 1")
    if o.threads < 1:
        p.error("--threads must be at least 1")
    if o.sphere and o.connected_comp:
        p.error("--sphere and --connected-comp exclude each other")
    if (o.input1 is None) != (o.input2 is None):
        p.error("--input1 and --input2 come together")
    if sum(x is not None for x in (o.path, o.input, o.input1)) > 1:
        p.error("more than one input")
    if o.non_redundant and (o.print_clusters or o.seq_id):
        p.error("--non-redundant excludes --print-clusters and --seq-id")
    if o.tidy and (o.non_redundant or o.print_clusters or o.seq_id):
        p.error("--tidy excludes --non-redundant, --print-clusters and --seq-id")
    if o.output and o.input1 and o.non_redundant:
        p.error("use --output1 and --output2 for non-redundant pairs")
    if (o.output1 or o.output2) and not (o.input1 and o.non_redundant):
        p.error("--output1 and --output2 are for non-redundant pairs")


def _emit(lines: DataFrame, path: str | None) -> None:
    if path:
        render.write(lines, path)
        return
    for row in lines.toLocalIterator():
        sys.stdout.write(row["value"] + "\n")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    o = p.parse_args(argv)
    check(p, o)
    spark = spark or SparkSession.builder.appName("seqbraid").master(f"local[{o.threads}]").getOrCreate()
    path = o.input or o.path or o.input1
    if path is None:
        text = spark.createDataFrame([(i, x.rstrip("\n")) for i, x in enumerate(sys.stdin, 1)], "line_no long, value string")
        from seqbraid.plans.shared import new_path

        path = new_path(spark, "stdin")
        text.orderBy("line_no").coalesce(1).select("value").write.text(path)
    names = {"mp": "mp", "s": "spheres", "cc": "components"}
    if o.cluster_ratio == 1:
        sys.stderr.write("warning: with a cluster ratio of 1, strings of equal counts join each other\n")
    try:
        reads = sources.read(spark, path, o.input2)
        if o.umi_len is not None:
            found = api.cluster_tags(reads, o.umi_len, o.umi_d, o.seq_d, o.seq_trim, names[o.umi_cluster], names[o.seq_cluster], o.umi_cluster_ratio, o.seq_cluster_ratio, o.seq_id)
            _emit(render.tag_lines(found, o.seq_id), o.output)
            return 0
        algorithm = "spheres" if o.sphere else "components" if o.connected_comp else "mp"
        done = api.cluster(reads, o.distance, o.cluster_ratio or 5.0, algorithm, with_info=o.non_redundant)
    except sources.InvalidInput as e:
        sys.stderr.write(f"{e}\n")
        return 1
    if not o.quiet:
        shape = done.uniq.agg({"cnt": "sum", "uid": "count"}).first()
        sys.stderr.write(f"{shape['sum(cnt)']} sequences, {shape['count(uid)']} of them different\ndistance {done.distance}\n{done.pairs.count()} similar pairs\n")
    if o.tidy:
        _emit(render.tidy_lines(done.tidy()), o.output)
    elif o.non_redundant:
        unique = done.non_redundant()
        if o.input2:
            for mate, source, out in ((1, o.input1, o.output1), (2, o.input2, o.output2)):
                _emit(render.unique_lines(unique, "fastq", mate), out or output_name(source))
        else:
            _emit(render.unique_lines(unique, sources.detect_format(spark, path)), o.output)
    else:
        _emit(render.cluster_lines(done.clusters(o.seq_id), o.print_clusters, o.seq_id), o.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
