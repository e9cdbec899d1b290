"""The derived corpus tables themselves, so that everything built on them rests on a checked base."""

from clausegrid.registry.core import query

for _name in (
    "circulars reference_texts paragraphs obligations packs clauses assessments findings steps "
    "outcomes circular_pages document_paragraphs"
).split():
    if _name == "document_paragraphs":
        query(
            "corpus_document_paragraphs",
            "SELECT doc_id, order_index, text, char_start, char_end FROM document_paragraphs",
        )(lambda c: c.document_paragraphs.drop("heading_path"))
    else:
        query(f"corpus_{_name}", f"SELECT * FROM {_name}")(lambda c, n=_name: getattr(c, n))
