from roadlines.llm import secrets


def test_copies_in_many_repositories_of_one_owner_are_examples(docs_of):
    n = secrets.MAX_REPOSITORIES
    many, few = "Qw9rTy7uIo5pAs3dFg1hJk", "Zx8cVb6nMa4sDf2gHj0kLq"
    rows = [(i, f"see {many} and AKIAABCDEFGH1234", None, "o") for i in range(n + 1)]
    rows += [(100 + i, f"see {few} and AKIAZZZZEFGH1234", None, "o") for i in range(n)]
    got = secrets.scan(docs_of(rows)).collect()
    for r in got:
        found = [(x.kind, x.live, x.owners, x.repositories) for x in r.spans]
        if r.doc_id < 100:
            assert found == [("access", False, 1, n + 1)]
        else:
            assert found == [("opaque", True, 1, n), ("access", True, 1, n)]
