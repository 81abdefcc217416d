"""Row rules over streams. The rules are projections, so a stream of records is checked as a table is."""
