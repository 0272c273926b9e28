"""python -m runlens STATE DOCS COMMAND: load a records file, train, score a batch, teach, show the status, converse."""

from __future__ import annotations

import argparse

from runlens.session import session
from runlens.shell import converse
from runlens.triage import Triage


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="runlens", description=__doc__)
    parser.add_argument("state", help="folder of the service's state")
    parser.add_argument("docs", help="folder of the Markdown documents")
    command = parser.add_subparsers(dest="command", required=True)
    command.add_parser("load", help="take over records and documents, and index them").add_argument("records")
    command.add_parser("train", help="fit and keep the forest")
    command.add_parser("batch", help="answers to a JSON array of records").add_argument("inputs")
    teach = command.add_parser("teach", help="correct an answer")
    teach.add_argument("text")
    teach.add_argument("path")
    command.add_parser("status")
    command.add_parser("chat")
    args = parser.parse_args(argv)

    triage = Triage(session(), args.state, args.docs)
    if args.command == "load":
        triage.load_records(args.records)
        triage.load_documents()
        triage.refresh_index("rebuild")
    elif args.command == "train":
        print(triage.train())
    elif args.command == "batch":
        for row in triage.batch(args.inputs).orderBy("qid").select("text", "doc_path", "shown", "source", "root_cause").toLocalIterator():
            print(" | ".join(x or "" for x in row))
    elif args.command == "teach":
        triage.teach(triage.spark.createDataFrame([(args.text, args.path)], "text string, correct_doc_path string"))
    elif args.command == "status":
        triage.status().show(truncate=False)
    else:
        converse(triage)


if __name__ == "__main__":
    main()
