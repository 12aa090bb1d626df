"""Runs from the command line: python -m seqweft corpus DATA_ROOT OUTPUT_ROOT; the exit code is 0 only if the run ended well [ERR-02]."""

from __future__ import annotations

import argparse
import sys
import traceback


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="seqweft")
    commands = parser.add_subparsers(dest="command", required=True)
    corpus = commands.add_parser("corpus", help="FASTA files to a corpus, its profiles and a manifest")
    corpus.add_argument("data_root")
    corpus.add_argument("output_root")
    corpus.add_argument("--manifest", help="where the manifest goes (by default nowhere)")
    corpus.add_argument("--strategies", nargs="+", default=["single", "3-mer", "5-mer", "bpe"])
    crawl = commands.add_parser("crawl", help="the crawl chain from a saved index page")
    crawl.add_argument("index_url")
    crawl.add_argument("index_file")
    crawl.add_argument("output_root")
    given = parser.parse_args(args)
    from seqweft.plans import corpus_profile, crawl_chain
    from seqweft.plans.run import RunConfig
    from seqweft.session import get_session
    from seqweft.sources.fetch import get

    try:
        spark = get_session("seqweft")
        if given.command == "corpus":
            manifest = corpus_profile.run(spark, RunConfig(given.data_root, given.output_root, strategies=tuple(given.strategies)))
            if given.manifest:
                manifest.write(given.manifest)
            return 0
        with open(given.index_file, encoding="utf-8") as f:
            index = spark.createDataFrame([(given.index_url, f.read())], "url string, html string")
        added = crawl_chain.run(spark, index, get, given.output_root)
        print(added)
        return 0
    except Exception:
        traceback.print_exc()
        return 1


if __name__ == "__main__":
    sys.exit(main())
