"""boxmeter.sources"""
