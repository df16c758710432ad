"""Where relations come from: tables, derived relations and document files."""
