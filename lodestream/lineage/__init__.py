"""Analysis of SQL text: what each script reads, writes and computes, as relations."""
