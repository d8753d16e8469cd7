"""DataFrame to DataFrame steps: filters, ranking, projections, selection, messages, manifests."""
