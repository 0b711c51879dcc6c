"""Plans made of operators: checklists, the knowledge graph, its queries, reports and exports."""
