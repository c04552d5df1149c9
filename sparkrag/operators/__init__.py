"""Set-oriented operators: ingestion, sections, chunks, embeddings, retrieval, answers, web evidence, evaluation, tenancy."""
